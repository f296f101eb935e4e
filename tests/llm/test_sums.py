"""Kernels that op1 and op8 share: sums by group, and numbers by byte planes."""

import numpy as np
import pyarrow as pa
import pytest

from agrolens.llm import decontaminate, maxent_lm
from agrolens.llm.common import grouped_sums, sums_by_size


@pytest.mark.parametrize("groups", [1, 5, 400])
def test_grouped_sums(groups):
    rnd = np.random.default_rng(groups)
    values = rnd.integers(-50, 50, (300, 7)).astype(np.float32)  # whole numbers, so sums are exact in any order
    of = np.sort(np.minimum(rnd.zipf(1.3, 3000) - 1, groups - 1))  # one large group, many of one row
    at = rnd.integers(0, len(values), len(of))
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    want = np.stack([values[at[of == g]].sum(axis=0) for g in np.unique(of)])
    assert (grouped_sums(values, at, first) == want).all()


def test_packed_numbers_take_little_more_than_their_low_bytes():
    rnd = np.random.default_rng(5)
    for kind in (np.uint8, np.int32, np.int64):
        codes = rnd.integers(0, 128, 100_000).astype(kind)
        codes[::1000] = np.iinfo(kind).max
        packed = maxent_lm._pack(codes)
        assert (maxent_lm._unpack(packed, kind) == codes).all() and len(packed) < 105_000
    assert len(maxent_lm._unpack(maxent_lm._pack(np.zeros(0, np.int32)), np.int32)) == 0


def test_words_are_numbered_as_they_come():
    code = maxent_lm.Codes()
    assert [code[w] for w in (b"b", b"a", b"b", b"")] == [0, 1, 0, 2] and list(code) == [b"b", b"a", b""]


def test_codes_are_laid_on_whole_passages():
    lists = [np.arange(1, 4), np.array([7]), np.arange(8)]
    codes, first, room = decontaminate.whole(lists, 4, 9)
    assert codes.reshape(-1, 4).tolist() == [[1, 2, 3, 9], [7, 9, 9, 9], [0, 1, 2, 3], [4, 5, 6, 7]]
    assert first.tolist() == [0, 4, 8] and room.tolist() == [4, 4, 8]


def test_arrow_numbers_the_same_tokens():
    texts = ["A  b\tC\n", "", " \n", None, "x", "a\x1cb\x1fc \x85 \xa0d e\x0b\x0cf\rg\x00h", "  Lead trail  ", "İK Z z", "b a"]
    code, sizes, codes = maxent_lm.Codes(), [], []
    for t in texts:
        words = maxent_lm.tokens(t)
        sizes.append(len(words))
        codes += [code[w] for w in words]
    for k in (1, 4, 9):  # words keep their numbers over pieces
        pieces = [maxent_lm.ended(pa.array(texts[i:i + k], pa.string())) for i in range(0, len(texts), k)]
        got, words = maxent_lm.numbered([p for p, _ in pieces])
        assert got.tolist() == codes and np.concatenate([n for _, n in pieces]).tolist() == sizes
        assert words.cast(pa.binary()).to_pylist() == list(code)


def test_sums_by_size_come_in_several_pieces():
    rnd = np.random.default_rng(8)
    values = rnd.integers(-50, 50, (900, 512)).astype(np.float32)  # 128 groups a piece
    of = np.sort(np.r_[np.zeros(700, int), np.arange(400), rnd.integers(0, 400, 500)])
    at = rnd.integers(0, len(values), len(of))
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    got = list(sums_by_size(values, at, first))
    assert len(got) == 4 and sorted(np.concatenate([g for g, _ in got]).tolist()) == list(range(400))
    for groups, total in got:
        assert all((total[i] == values[at[of == g]].sum(axis=0)).all() for i, g in enumerate(groups))


def plain_log_p(table, rows, bias):
    z = table.astype(float)[rows].sum(axis=0) + (table[0].astype(float) if bias else 0)
    z -= z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


@pytest.mark.parametrize("bias", [True, False])
@pytest.mark.parametrize("scale", [1, 300])
def test_softmax_by_products_equals_the_plain_one(bias, scale):
    rnd = np.random.default_rng(scale)
    table = (rnd.standard_normal((50, 7)) * scale).astype(np.float32)  # 300: products below what float32 holds
    rows, y = rnd.integers(1, 50, (3, 12_000)), rnd.integers(0, 7, 12_000)
    want = plain_log_p(table, rows, bias)
    got = maxent_lm.Factors(table, bias).log_p(rows, y)
    assert np.allclose(got, want[np.arange(len(y)), y], rtol=2e-6, atol=2e-5 * scale ** .5)
    plain = maxent_lm._plain(table, 0.1, 3 + bias)
    assert plain == (scale == 1)
    assert np.allclose(maxent_lm._probabilities(table, rows, bias, plain), np.exp(want), rtol=1e-3 if scale > 1 else 2e-5, atol=1e-12)


def test_a_step_is_the_plain_adaptive_gradient_step():
    rnd = np.random.default_rng(3)
    table, rows, y = rnd.standard_normal((30, 5)).astype(np.float32), rnd.integers(1, 30, (3, 200)), rnd.integers(0, 5, 200)
    g = np.exp(plain_log_p(table, rows, True))
    g[np.arange(200), y] -= 1
    total = np.zeros((30, 5))
    for r in rows:
        np.add.at(total, r, g)
    total[0] = g.sum(axis=0)
    for plain in (True, False):
        new, square = table.copy(), np.zeros_like(table)
        maxent_lm._step(new, square, rows, y, 0.1, True, plain)
        assert np.allclose(square, total ** 2, rtol=1e-3, atol=1e-5)
        assert np.allclose(new, table - 0.1 * total / np.sqrt(total ** 2 + 1e-6), atol=1e-4)


def test_rest_is_the_remainder():
    a = np.random.default_rng(4).integers(-1 << 62, 1 << 62, 10_000)
    assert (maxent_lm._rest(a, 16383) == a % 16383).all()
