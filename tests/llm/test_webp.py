import numpy as np
import pytest

from weft.llm.webp import COLOR_INDEXING, CROSS_COLOR, PREDICTOR, SUBTRACT_GREEN, decode, encode, load, near_offsets, read_media, store, store_texts, to_payload

rng = np.random.default_rng(5)


def image(h, w, colors):
    if colors is None:
        y, x = np.mgrid[0:h, 0:w]
        return (0xFF000000 | ((x * 3 + y) % 256) << 16 | ((x + y * 2) % 256) << 8 | ((x * y) % 256)).astype(np.uint32)
    palette = rng.integers(0, 1 << 32, colors, dtype=np.uint32)
    return palette[rng.integers(0, colors, (h, w))]


@pytest.mark.parametrize("shape", [(1, 1), (1, 9), (7, 5), (33, 20)])
@pytest.mark.parametrize("colors", [None, 1, 3, 200])
def test_all_means_round_trip(shape, colors):
    im = image(*shape, colors)
    chains = [(), (PREDICTOR,), (CROSS_COLOR,), (SUBTRACT_GREEN,), (PREDICTOR, CROSS_COLOR, SUBTRACT_GREEN)] + ([(COLOR_INDEXING,), (COLOR_INDEXING, PREDICTOR)] if colors else [])
    for chain in chains:
        for cache in (0, 4):
            for lz in (False, True):
                assert (decode(encode(im, chain, cache, lz, modes=range(14), block_bits=2)) == im).all()


@pytest.mark.parametrize("colors", [1, 2, 3, 4, 5, 16, 17, 256])
def test_palettes(colors):
    im = image(9, 13, colors)
    assert (decode(encode(im, (COLOR_INDEXING,), lz=True)) == im).all()


def test_near_offsets():
    near = near_offsets()
    assert len(near) == len(set(near)) == 120 and near[:5] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2)] and near[-1] == (8, 7)


def test_payloads():
    for data in (b"", b"x", bytes(range(256)) * 9, "é日".encode() * 5000, b"a" * (576 * 16001)):
        p = to_payload(data)
        assert len(p) % 576 == 0 and len(p) >= 576 and p.startswith(data) and set(p[len(data) :]) <= {255}
        assert load(store(p)).tobytes() == p
    with pytest.raises(ValueError):
        decode(b"RIFF1234WEBX")


def test_rows(spark, odd_docs, no_docs):
    import hashlib
    import zlib

    got = read_media(store_texts(odd_docs)).collect()
    texts = [r["text"] for r in odd_docs.select("text").collect()]
    want = []
    for t in texts:
        p = to_payload((t or "").encode())
        want.append((len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    assert sorted((r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == sorted(want)
    assert len({(r["media_sha256"], r["feature"]) for r in got}) == len({(t or "") for t in texts})
    assert read_media(store_texts(no_docs)).count() == 0


def test_stored_texts_use_every_means(spark):
    from collections import Counter

    from weft.session import table

    tally = Counter()
    for r in table(spark, "/root/testdata/sf0.01", "documents").select("text").collect():
        payload = to_payload((r["text"] or "").encode())
        assert load(store(payload), tally).tobytes() == payload
    for means in ("palette", "predictor", "cross-colour", "subtract green", "back-references", "colour cache", "unequal code lengths"):
        assert tally[means] >= 20, (means, tally)


def test_broken_streams_raise():
    payload = to_payload(bytes(range(256)) * 40)
    whole = store(payload)
    for cut in (30, 60, len(whole) // 2):
        stream = whole[20:cut]
        with pytest.raises((EOFError, ValueError)):
            decode(b"RIFF" + (12 + len(stream)).to_bytes(4, "little") + b"WEBPVP8L" + len(stream).to_bytes(4, "little") + stream)


def test_many_values_are_written_as_one_by_one():
    from weft.llm.webp import BitReader, BitWriter

    widths = rng.integers(0, 65, 3000).astype(np.uint64)
    values = np.array([int(v) & ((1 << int(n)) - 1) for v, n in zip(rng.integers(0, 1 << 64, 3000, dtype=np.uint64), widths, strict=True)], np.uint64)
    many, single = BitWriter(), BitWriter()
    for w in (many, single):
        w.write(5, 3)
    many.write_many(values, widths)
    for v, n in zip(values.tolist(), widths.tolist(), strict=True):
        single.write(v, n)
    assert many.bytes() == single.bytes() and many.length == single.length
    bits = BitReader(many.bytes())
    assert bits.read(3) == 5 and [bits.look(at, n) for at, n in zip((3 + np.cumsum(widths) - widths).astype(int).tolist(), widths.astype(int).tolist(), strict=True)] == values.tolist()


def test_code_lengths_are_least():
    from heapq import heapify, heappop, heappush

    from weft.llm.webp import code_lengths

    for n in (2, 3, 40, 256):
        for top in (2, 50, 10**6):
            counts = rng.integers(0, top, n)
            counts[:2] += 1
            heap, cost = [int(c) for c in counts if c], 0
            heapify(heap)
            while len(heap) > 1:
                joined = heappop(heap) + heappop(heap)
                heappush(heap, joined)
                cost += joined
            lengths = code_lengths(counts, 40)
            assert (counts * lengths).sum() == cost and ((lengths > 0) == (counts > 0)).all()
            held = code_lengths(counts, 9)
            assert held.max() <= 9 and (0.5 ** held[held > 0]).sum() == 1


def test_calls_of_a_text_are_few(spark):
    """The time of a short text goes by the calls made for it: 3,500 before codes were read and written by tables."""
    import cProfile
    import pstats

    from weft.llm.webp import _read
    from weft.session import table

    payloads = [to_payload((r["text"] or "").encode()) for r in table(spark, "/root/testdata/sf0.01", "documents").select("text").limit(300).collect()]
    run = lambda: [_read(store(p)) for p in payloads]
    run()
    profile = cProfile.Profile()
    profile.runcall(run)
    assert pstats.Stats(profile).total_calls < 2500 * len(payloads)
