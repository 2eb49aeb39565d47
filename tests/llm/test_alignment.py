"""Token alignment against the unmodified libraries and plain sets of byte ends."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodemark.llm import alignment as A
from lodemark.llm import queries as Q


@pytest.fixture(scope="module")
def tokenize():
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(Q.BYTE_PAIRS), sentencepiece.SentencePieceProcessor(model_file=Q.PIECES)
    a.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(x): x for x in printable} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in printable)}

    def both(text):
        ids = a.encode(" " + text, add_special_tokens=False).ids
        pieces = b.encode(text, num_threads=1)
        as_bytes = lambda p: bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()
        return [(i, bytes(chars[c] for c in a.id_to_token(i))) for i in ids], [(i, as_bytes(b.id_to_piece(i))) for i in pieces]

    return both


def brute(texts, tokenize):
    docs, held = [], Counter()
    for text in texts:
        a, b = tokenize(text) if text else ([], [])
        if not text or not b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode():
            docs.append(None)
            continue
        ends = [np.cumsum([len(x) for _, x in side]).tolist() for side in (a, b)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, at = [], [0, 0]
        for c in cuts:
            to = [es.index(c, at[k]) + 1 for k, es in enumerate(ends)]
            groups.append(tuple([i for i, _ in side[at[k] : to[k]]] for k, side in enumerate((a, b))))
            at = to
        links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        held.update(set(links))
        docs.append((len(a), len(b), groups, links))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in d[2])
            sums = sum(held[p] == best[p[0]] for p in d[3]), sum(held[p] for p in d[3])
            out.append((d[0], d[1], len(d[2]), len(d[3]), *sums, hashlib.sha256(text.encode()).hexdigest()))
    return out


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def check(spark, texts, tokenize, **how):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, pair string").repartition(3)
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in A.align_documents(df, Q.BYTE_PAIRS, Q.PIECES, **how).collect()}
    want = brute(texts, tokenize)
    for i, t in enumerate(texts):
        assert got[i] == want[i], (i, t if t is None else t[:80], got[i], want[i])
    assert len(got) == len(texts)


ODD = [
    " lead", "trail ", "a  b", "a\n\nb", "a\nb c\nd", "\n", " ", "tab\tbed", "a\r\nb", "<|endoftext|> is text <s> </s> <unk> <0x0A>", "a▁b", "▁", "x ▁y",
    "é é ﬁ ＡＢＣ ½ Å", "漢字かな交じり文", "🙂🙂 🙃", "\x00 nul", "don't it's we'll I'M", "x" * 3000, "ab" * 999 + " " + "é" * 500, "a b", "1234567 3.14 -- !!!", "٣٤ हिन्दी ไทย", "﻿bom", "a b", "À\nB ", "Ünïcödé\nwörds hère",
]


def test_odd_texts_and_fixture(spark, documents, tokenize):
    texts = [r["text"] for r in documents.select("text").collect()]
    check(spark, [*ODD, *ODD[:5], *texts], tokenize)


def test_supplied_documents_on_both_paths(spark, sf_dir, tokenize):
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(spark, texts, tokenize)
    check(spark, [*texts[:60], *ODD], tokenize, most=0)


def test_random_ends():
    r = random.Random(2)
    for _ in range(200):
        n = r.randint(1, 300)
        sides = [sorted({n, *r.sample(range(1, n + 1), r.randint(0, n // r.choice([1, 3, 9])))}) for _ in range(2)]
        sizes = [np.diff([0, *s]) for s in sides]
        ids = [np.array([r.randint(0, 5) for _ in s], dtype="i8") for s in sides]
        g = A.align(*sizes)
        assert g.ends.tolist() == sorted(set(sides[0]) & set(sides[1]))
        pairs, times, of = A.links(g, *ids)
        want = Counter((k, int(x) << 32 | int(y)) for k in range(len(g.ends)) for x in ids[0][g.a[k] : g.a[k + 1]] for y in ids[1][g.b[k] : g.b[k + 1]])
        got = Counter()
        for k, p, t in zip(of.tolist(), pairs.tolist(), times.tolist(), strict=True):
            got[k, p] += t
        assert got == want


def test_large_groups_count_all_their_links():
    sizes, ids = [np.array([1, *[2] * 50, 1]), np.array([*[2] * 51])], [np.arange(52) % 4, np.arange(51) % 3]
    g = A.align(*sizes)
    assert len(g.ends) == 1
    pairs, times, _ = A.links(g, *ids)
    assert times.sum() == 52 * 51 and len(pairs) == 12


def test_other_bytes_are_refused():
    with pytest.raises(ValueError):
        A.align(np.array([1, 2]), np.array([2]))


def test_empty_table(spark, no_documents):
    assert A.align_documents(no_documents, Q.BYTE_PAIRS, Q.PIECES).collect() == []
