"""Round trips of media files, url rules by brute force, packings checked piece by piece."""

import hashlib
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from edgeloom.llm import media, packing, urlfilter

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def test_media_round_trip(odd, none):
    rows, df = odd
    got = media.read_media(media.store_media(df)).drop("clips", "error")
    want = []
    for i, t in rows:
        body = (t or "").encode()
        body = body.ljust(max(64, -(-len(body) // 64) * 64), b"\0")
        want.append((i, len((t or "").encode()), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:])))
    assert brute.rows_of(got, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == sorted(want, key=str)
    files = brute.rows_of(media.store_media(df), "media", "n_bytes")
    assert sorted(brute.rows_of(got, "media_sha256", "media_bytes")) == sorted((hashlib.sha256(x).hexdigest(), len(x)) for x, _ in files)
    assert media.clips(media.store_media(none)).count() == 0


def test_frames_of_all_levels_and_foreign_blocks():
    samples = np.random.default_rng(0).integers(0, 256, (media.ROWS * 5, media.ACROSS)).astype(np.uint8)
    images = media.frames(samples)
    head = media.parse_header(images[0])
    assert (media.decode([x[head["size"] :] for x in images], head).reshape(samples.shape) == samples).all()
    # One interval of two blocks with AC terms: DC 1 (size 1), AC (0, 1), end; DC 0, end.
    dc, ac = ([0, 2] + [0] * 14, [0, 1]), ([1, 1] + [0] * 14, [0, 1])
    head = {"dc": media._lookup(*dc), "ac": media._lookup(*ac), "blocks": 2, "restart": 0, "quantiser": 8}
    bits = "01" + "1" + "10" + "1" + "0" + "00" + "0"
    coded = int(bits.ljust(16, "1"), 2).to_bytes(2, "big") + b"\xff\xd9"
    assert media.decode([coded, coded], head).tolist() == [[129, 129]] * 2


def test_shots_are_cut_where_the_content_changes(spark):
    a, b = "etaoin " * 800, "0123456789" * 600
    rows = spark.createDataFrame([(1, a + b), (2, a), (3, None)], "doc_id long, text string")
    found = {}
    for r in media.clips(media.store_media(rows)).orderBy("doc_id", "clip").collect():
        found.setdefault(r.doc_id, []).append((r.first_frame, r.frames, r.start_s, r.end_s))
    assert [x[0] for x in found[1]] in ([0, 10], [0, 11], [0, 10, 11]) and len(found[2]) == 1 and len(found[3]) == 1
    assert found[1][0][3] == found[1][1][2] == found[1][1][0] / media.FPS
    files = spark.createDataFrame([(1, None)], "doc_id long, media binary")
    assert media.read_media(files).first()["clips"] is None


def test_foreign_and_broken_files(spark):
    """They end no job, carry the reason, and change nothing for the files beside them."""
    import struct

    good = [bytes(r.media) for r in media.store_media(spark.createDataFrame([(1, "word " * 900), (2, "x")], "doc_id long, text string")).orderBy("doc_id").collect()]
    size = struct.pack(">HH", media.ROWS * 8, media.ACROSS * 8)
    assert size in good[0]
    lower = good[0].replace(size, struct.pack(">HH", media.ROWS * 4, media.ACROSS * 8))
    vast = good[0].replace(size, b"\xff\xff\xff\xff")
    files = [good[0], b"", b"junk", good[0][: len(good[0]) // 2], lower, vast, None, good[1]]
    rows = spark.createDataFrame([(i, None if x is None else bytearray(x)) for i, x in enumerate(files)], "doc_id long, media binary").coalesce(1)
    got = {r.doc_id: r for r in media.read_media(rows).collect()}
    alone = {r.doc_id: r for r in media.read_media(rows.filter("doc_id in (0, 7)")).collect()}
    assert got[0] == alone[0] and got[7] == alone[7] and alone[0].error is None
    assert all(got[i].error and got[i].clips is None and got[i].payload_bytes is None for i in (1, 2, 3, 5))
    assert got[6].error is None and got[6].clips is None
    assert set(got) == set(range(8))


URLS = ["http://A.Example.org/es/1", "https://example.org/en/12?x", "example.org/es/", "http://b.com/de/1", "http://com/fr/", "http://b.com/fr/#a", "ftp://x.net/", None, "", "http://", "://org/", "http://org", "http://xorg/", "http://a.org:80/", "http://example.org/en/2", "http://b.com/DE/", "http://..org/", "x://example.org/es", "http://example.org?/es/"]
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    for c in "?#":
        rest = rest.split(c)[0]
    host, slash, path = rest.partition("/")
    host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), slash + path
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fits, default=(0, None, "allow"))
    return host, path, rule, verdict


@pytest.mark.parametrize("bits,segment", [(16, 1_000_000), (1, 2)])
def test_url_rules(spark, monkeypatch, bits, segment):
    monkeypatch.setattr(urlfilter, "BITS", bits)  # small filters let much through: several levels
    monkeypatch.setattr(urlfilter.Cascade.__init__, "__defaults__", (segment,))
    rows = [(i, u) for i, u in enumerate(URLS)] + [(None, URLS[0]), (0, URLS[0])]
    rows += [(1000 + i, f"http://h{i}.example.org/{p}/{i}") for i in range(60) for p in ("es", "en", "fr")]
    pages = spark.createDataFrame([(i, u, 1, "x") for i, u in rows], "page_id long, url string, key int, rule string")
    got = urlfilter.judge(pages, urlfilter.rules_table(spark, RULES))
    assert brute.rows_of(got, *got.columns) == sorted(((i, *judged(u)) for i, u in rows), key=str)


def test_url_lists_without_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    assert urlfilter.judge(pages, urlfilter.rules_table(spark, [])).collect()[0].asDict() == {"page_id": 1, "host": "a.org", "path": "/x", "rule": None, "verdict": "allow"}
    assert urlfilter.judge(pages.limit(0), urlfilter.rules_table(spark, RULES)).count() == 0


def checked(out, rows, size):
    """Whether pieces are those of the documents and fill their sequences without gaps; the number of sequences."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCABULARY)
    pdf = out.toPandas()
    by_doc = {}
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % size or size
        cuts = [0, *range(first, len(ids) + 1, size)]
        by_doc.setdefault(i, []).extend((n, a, z - a, zlib.crc32(ids[a:z].tobytes())) for n, (a, z) in enumerate(zip(cuts, cuts[1:])))
    got = {}
    for r in pdf.itertuples():
        got.setdefault(None if r.doc_id != r.doc_id else int(r.doc_id), []).append((r.piece, r.start, r.length, r.ids_crc32))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in by_doc.items()}
    pdf = pdf.sort_values(["sequence_id", "offset"])
    ends = pdf.offset + pdf.length
    assert ends.max() <= size
    assert (pdf.offset == ends.groupby(pdf.sequence_id).shift(1).fillna(0)).all()
    return pdf.sequence_id.nunique(), int(pdf.length.sum())


@pytest.mark.parametrize("size", [2048, 64])
def test_packing(odd, none, size):
    rows, df = odd
    sequences, tokens = checked(packing.packed(df, VOCABULARY, size=size), rows, size)
    assert sequences <= -(-tokens // size) + 2
    assert packing.packed(none, VOCABULARY).count() == 0


def test_packing_of_special_strings(spark):
    end = "<|endoftext|>"
    texts = [f"a {end} b", end, end * 3, f" {end} ", f"x{end}y\n{end}", f"word \n {end}\t\t word", f"{end[:-1]} <|ENDOFTEXT|> <{end}>", f"é {end}é " * 50]
    checked(packing.packed(brute.frame(spark, list(enumerate(texts))), VOCABULARY, size=64), list(enumerate(texts)), 64)


def test_best_two_fit_replaces_the_smallest():
    # Greedy: 6 + 3, one place left. The 3 gives way to 2 + 2.
    fillings = packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)
    assert fillings == [({6: 1, 2: 2}, 1), ({3: 1}, 1)]
    for _ in range(50):
        counts = {int(k): int(n) for k, n in zip(np.random.randint(1, 101, 12), np.random.randint(1, 9, 12))}
        used = {}
        for filling, times in packing.best_two_fit(counts, 100):
            assert sum(k * n for k, n in filling.items()) <= 100
            for k, n in filling.items():
                used[k] = used.get(k, 0) + n * times
        assert used == counts


def test_pieces_hold_their_ids(odd):
    _, df = odd
    wrong = F.udf(lambda ids, n, crc: len(ids) != n or zlib.crc32(np.array(ids, "<u4").tobytes()) != crc, "boolean")
    assert packing.token_pieces(df, VOCABULARY, ids=True).filter(wrong("ids", "length", "ids_crc32")).count() == 0
