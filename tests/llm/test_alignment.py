"""Alignment of two tokenizers against a plain version built on the libraries themselves."""

import hashlib
import re
from collections import Counter

import brute
import public_tokenizers
import pytest

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    one, two = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}

    def piece(i):
        byte = re.fullmatch("<0x(..)>", two.id_to_piece(i))
        return bytes([int(byte[1], 16)]) if byte else two.id_to_piece(i).replace("▁", " ").encode()

    def ends(tokens):
        out, at = {}, 0
        for k, t in enumerate(tokens):
            at += len(t)
            out[at] = k
        return out

    docs, counts = [], Counter()
    for doc, text in rows:
        text = text or ""
        a, b = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)
        bytes_a, bytes_b = [bytes(of[c] for c in one.id_to_token(i)) for i in a], [piece(i) for i in b]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            docs.append((doc, [], [], [], ""))
            continue
        ends_a, ends_b = ends(bytes_a), ends(bytes_b)
        links, groups, i, j = [], [], 0, 0
        for e in sorted(ends_a.keys() & ends_b.keys()):
            x, y = ends_a[e] + 1, ends_b[e] + 1
            groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
            links.append((a[x - 1], b[y - 1]))
            i, j = x, y
        counts.update(links)
        docs.append((doc, a, b, links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [(d, len(a), len(b), len(x), len(x), sum(counts[p] == best[p[1]] for p in x), sum(counts[p] for p in x), h) for d, a, b, x, h in docs]


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("run_bytes", [4 << 20, 1500])
def test_equals_plain_version(spark, odd, run_bytes):
    from edgeloom.llm.alignment import align

    rows = odd[0] + [(9002, "a▁b"), (9003, "<s> <|endoftext|> </s> <0x0A>"), (9004, "\x00\n\t é 漢字 😀"), (9005, " "), (9006, "  two  blanks  "), (9007, "한국어 Straße  ")]
    docs = brute.frame(spark, rows).repartition(3)
    assert brute.rows_of(align(docs, A, B, run_bytes=run_bytes), *COLUMNS) == sorted(plain(rows), key=str)


def test_empty_table(none):
    from edgeloom.llm.alignment import align

    assert align(none, A, B).collect() == []
