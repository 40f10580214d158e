import numpy as np
import pyarrow as pa

from phasemill.llm import words as W


def test_segments_stay_within_rows_and_hash_alike():
    column = pa.array(["ab cd", None, "", "cd", " x ", "ab cd"])
    (first, last, data, offsets), = list(W.blocks(column))
    starts, ends, bounds = W.segment(data, offsets, W.SPACED)
    assert (first, last) == (0, 6)
    assert [data[a:b].tobytes() for a, b in zip(starts, ends)] == [b"ab", b"cd", b"cd", b"x", b"ab", b"cd"]
    assert np.diff(bounds).tolist() == [2, 0, 0, 1, 1, 2]
    h = W.span_hashes(data, starts, ends)
    assert h[0] == h[4] and h[1] == h[2] == h[5] and len(set(h.tolist())) == 3


def test_hashes_do_not_depend_on_place_or_size_of_the_buffer():
    long = "z" * 1_200_000 + " tail " + "y" * 600_000 + " tail"
    (_, _, data, offsets), = list(W.blocks(pa.array([long])))
    starts, ends, _ = W.segment(data, offsets, W.SPACED)
    h = W.span_hashes(data, starts, ends)
    small = np.frombuffer(b"tail", dtype=np.uint8)
    assert h[1] == h[3] == W.span_hashes(small, np.array([0]), np.array([4]))[0]


def test_blocks_split_by_bytes():
    parts = list(W.blocks(pa.array(["a" * 10] * 10), 25))
    assert [(a, b) for a, b, _, _ in parts] == [(0, 2), (2, 4), (4, 6), (6, 8), (8, 10)]
    assert list(W.blocks(pa.array([], pa.string()))) == []


def test_windows_and_repeats():
    (_, _, data, offsets), = list(W.blocks(pa.array(["a b a b a", "b a", "a"])))
    starts, ends, bounds = W.segment(data, offsets, W.SPACED)
    keys, whole = W.window_hashes(W.span_hashes(data, starts, ends), bounds, 2)
    assert whole.tolist() == [True] * 4 + [False, True, False, False]
    assert keys[0] == keys[2] and keys[1] == keys[3] == keys[5]
    assert W.again(np.array([5, 1, 5, 2])).tolist() == [True, False, True, False]
    assert W.later(np.array([5, 1, 5, 2])).tolist() == [False, False, True, False]


def morse(n, a="a", b="b"):
    """The Thue-Morse string of n letters (a power of two) and its complement, which collide in any polynomial hash modulo 2^64 from 1,024 letters on."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


def test_patterned_spans_do_not_collide():
    x, y = morse(2048)
    (_, _, data, offsets), = list(W.blocks(pa.array([f"{x} {y} {x}"])))
    starts, ends, _ = W.segment(data, offsets, W.SPACED)
    a, b, c = W.span_hashes(data, starts, ends)
    assert a == c != b
    assert len(set(W.rolling_hashes(data, starts, ends).tolist())) == 1  # what the other hash is for


def test_hashes_of_any_length_and_overlap():
    rng = np.random.default_rng(5)
    data = rng.integers(0, 2, 700_000, dtype=np.uint8)
    starts = np.sort(rng.integers(0, 600_000, 3000))
    starts[:40] = 7
    ends = np.minimum(starts + rng.integers(0, 40, 3000), len(data))
    ends[100], ends[200] = starts[100] + 90_000, len(data)
    h = W.span_hashes(data, starts, ends)
    by = {}
    for s, e, k in zip(starts, ends, h.tolist(), strict=True):
        assert by.setdefault(data[s:e].tobytes(), k) == k
    assert len(set(by.values())) == len(by)
    assert h[100] == W.span_hashes(data[starts[100] : ends[100]].copy(), np.array([0]), np.array([90_000]))[0]
