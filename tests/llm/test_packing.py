import random
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from rows import LONG, documents, texts
from tokenizers import Tokenizer

from logspark.llm.packing import TOKENIZER, WordIds, best_fit_runs, pack, sequences


@lru_cache
def tokenizer():
    return Tokenizer.from_file(TOKENIZER)


def whole_ids(text):
    return tokenizer().encode(text, add_special_tokens=False).ids


def best_fit(lengths, size):
    """One piece after the other into the tightest open bin."""
    room = []
    for length in sorted(lengths, reverse=True):
        fit = [(r, i) for i, r in enumerate(room) if r >= length]
        if fit:
            room[min(fit)[1]] -= length
        else:
            room.append(size - length)
    return sorted(room)


def placed(histogram, size):
    """Every piece's bin and offset by the runs."""
    runs, out = best_fit_runs(histogram, size), []
    counts = dict(histogram)
    for row, later in zip(runs.tolist(), [*runs.tolist()[1:], [0]], strict=True):
        length, nth, first, per_bin, offset = row
        end = later[1] if later[0] == length else counts[length]
        out += [(first + k // per_bin, offset + k % per_bin * length, length) for k in range(end - nth)]
    return out


def check_bins(pieces, size):
    bins = defaultdict(list)
    for number, offset, length in pieces:
        bins[number].append((offset, length))
    assert set(bins) == set(range(len(bins)))
    rooms = []
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= size
        rooms.append(size - at)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(40))
def test_runs_are_best_fit_decreasing(seed):
    rng = random.Random(seed)
    size = rng.choice([1, 2, 7, 16, 60, 100])
    lengths = [min(size, max(1, int(rng.expovariate(3 / size)))) for _ in range(rng.randrange(300))]
    pieces = placed(list(Counter(lengths).items()), size)
    assert Counter(x[2] for x in pieces) == Counter(lengths)
    assert check_bins(pieces, size) == best_fit(lengths, size)


def test_steps_do_not_grow_with_the_rows():
    histogram = [(n, 10**9 + n) for n in range(1, 4097, 7)]
    runs = best_fit_runs(histogram, 4096)
    assert len(runs) < 20_000


def test_ids_of_words_are_ids_of_texts():
    rng = random.Random(5)
    parts = ["don't", "I'LL", "x1y22", "Straße", "İstanbul", "é", "́", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c",
             "\x85", " ", "　", " ", "<|endoftext|>", "<|", "!?", "…", "日本語", "한국", "\U0001f600", "\x00", "Å", "Σ", "ας"]
    parts += ["'", "s", "re'", "«", "ÀÖ", "ÿß", "µ", "ª", "²", "½", "\xad", "—", "’s", "_", "-", "0", "9", "¡¿", "×", "„", "€", "\x7f", "\x1f", "ſ", "K"]
    coder = WordIds(TOKENIZER)
    plain = [p for p in parts if p.isascii() and p.isprintable() and "<" not in p] + ["ß", "É", "«", "a.", "b!?", "c'd,", " "]
    for n in range(3000):
        text = "".join(rng.choice(plain if n % 2 else parts) for _ in range(rng.randrange(25)))
        assert np.frombuffer(coder.of(text), "<u4").tolist() == whole_ids(text), repr(text)
    assert np.frombuffer(coder.of(LONG), "<u4").tolist() == whole_ids(LONG)


def test_awkward_rows(spark):
    size = 50
    packed = pack(documents(spark), max_tokens=size, ids=True)
    got = packed.collect()
    want = Counter()
    for i, text, _, _ in texts():
        ids = [*whole_ids(text or ""), 1]
        for piece, at in enumerate(range(0, len(ids), size)):
            part = np.array(ids[at : at + size], "<u4").tobytes()
            want[i, piece, at, len(part) // 4, zlib.crc32(part), part] += 1
    assert Counter((r.id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in got) == want
    rooms = check_bins([(r.sequence_id, r.offset, r.length) for r in got], size)
    assert rooms == best_fit([r.length for r in got], size)
    made = {r.sequence_id: r for r in sequences(packed).collect()}
    assert len(made) == len(rooms)
    for r in got:
        assert bytes(made[r.sequence_id].ids)[4 * r.offset :][: 4 * r.length] == bytes(r.ids)
        assert r.id in made[r.sequence_id].documents


def test_one_hot_length(spark):
    rows = [(i % 3, "a b c", "en", "s") for i in range(3000)] + [(9, "a", "en", "s")]
    got = pack(documents(spark, rows), max_tokens=10).collect()
    assert len(got) == 3001
    assert check_bins([(r.sequence_id, r.offset, r.length) for r in got], 10) == best_fit([4] * 3000 + [2], 10)


def test_empty_table(spark):
    assert pack(documents(spark, [])).collect() == []
