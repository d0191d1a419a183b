"""Token alignment against a loop over bytes and pairs."""

import hashlib
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidemark.llm.alignment import aligned, op13_token_alignment
from tidemark.llm.token_counts import vocabulary_path

A, B = vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


def brute(rows):
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letter = {chr(x): x for x in shown} | {chr(0x100 + i): x for i, x in enumerate(x for x in range(256) if x not in shown)}
    docs = []
    for doc_id, text in rows:
        one, two = [], []
        if text:
            one = [(i, bytes(letter[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
            for i in b.encode(text):
                piece = b.id_to_piece(i)
                two.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
            whole = (" " + text).encode()
            if b"".join(x for _, x in one) != whole or b"".join(x for _, x in two) != whole:
                one, two = [], []
        spans = []
        for tokens in (one, two):
            at, out = 0, []
            for i, x in tokens:
                out.append((i, at, at + len(x)))
                at += len(x)
            spans.append(out)
        cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, lo = [], 0
        for hi in cuts:
            groups.append("|".join(",".join(str(i) for i, s, e in side if lo <= s and e <= hi) for side in spans))
            lo = hi
        links = [(i, j) for i, s, e in spans[0] for j, t, u in spans[1] if s < u and t < e] if len(spans[0]) < 3000 else []
        docs.append((doc_id, len(one), len(two), groups, links))
    count = Counter(p for *_, links in docs for p in set(links))
    best = {}
    for (i, _), c in count.items():
        best[i] = max(best.get(i, 0), c)
    return sorted(
        (
            -1 if d is None else d, n, m, len(g), len(k), sum(count[p] == best[p[0]] for p in k), sum(count[p] for p in k),
            hashlib.sha256(";".join(g).encode()).hexdigest() if g else "",
        )
        for d, n, m, g, k in docs
    )


def got(df):
    return sorted(
        (-1 if r.doc_id is None else r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)
        for r in df.collect()
    )


@pytest.mark.parametrize("common", [0, 20, 1 << 19])
def test_odd_rows(spark, common):
    rows = [
        (1, "Naïve café  déjà-vu!"), (2, None), (3, ""), (4, " "), (5, "a▁b"), (6, "<|endoftext|> and <s> text </s>"),
        (7, "日本語のテキスト 🙂🙂\n\ttabs"), (1, "Naïve café  déjà-vu!"), (None, "no id, café"), (8, "x" * 3000), (9, "\x00\x01 ctl"),
        (10, "trailing  \n\n"), (11, "Donaudampfschifffahrtsgesellschaft naïve"), (12, "é" * 50),
    ]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id bigint, text string, row string").repartition(3)
    assert got(aligned(df, A, B, common)) == brute(rows)
    assert aligned(df.where("row = ''"), A, B).count() == 0


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    short = [r for r in rows if len(r[1] or "") < 4000]
    df = spark.createDataFrame(short, "doc_id bigint, text string")
    assert got(aligned(df, A, B, 100)) == brute(short)
    assert op13_token_alignment(spark, SF).count() == len(rows)
