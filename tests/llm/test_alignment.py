"""Cross-tokenizer alignment against plain loops over the tokenizers' own libraries."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from rubrica.llm import alignment
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

SMALL = "/root/testdata/sf0.001"


class Plain:
    def __init__(self):
        self.a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
        marks = sorted({*range(33, 127), *range(161, 173), *range(174, 256)})
        others = [b for b in range(256) if b not in marks]
        self.letter = {chr(b): b for b in marks} | {chr(256 + i): b for i, b in enumerate(others)}

    def piece(self, i):
        p = self.b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode()

    def spans(self, text):
        """Spans of both, or none."""
        if not text:
            return [], []
        out = []
        ids = self.a.encode(" " + text, add_special_tokens=False).ids
        for these, raw in (
            (ids, lambda i: bytes(self.letter[c] for c in self.a.id_to_token(i))),
            (self.b.encode(text), self.piece),
        ):
            at, spans = 0, []
            for i in these:
                spans.append((i, at, at + len(raw(i))))
                at = spans[-1][2]
            if b"".join(raw(i) for i in these) != (" " + text).encode():
                return [], []
            out.append(spans)
        return out


def expected(texts):
    plain, rows, documents = Plain(), [], Counter()
    for text in texts:
        a, b = plain.spans(text)
        cuts = sorted({x[2] for x in a} & {x[2] for x in b})
        groups, start = [], 0
        for cut in cuts:
            sides = [",".join(str(i) for i, s, e in side if start <= s and e <= cut) for side in (a, b)]
            groups.append("|".join(sides))
            start = cut
        links, j = [], 0
        for i, s, e in a:
            while j and b[j][1] > s:
                j -= 1
            while j < len(b) and b[j][2] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][1] < e:
                links.append((i, b[k][0]))
                k += 1
        documents.update(set(links))
        rows.append((a, b, groups, links))
    best = defaultdict(int)
    for (i, _), n in documents.items():
        best[i] = max(best[i], n)
    out = []
    for a, b, groups, links in rows:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        n_best = sum(documents[x] == best[x[0]] for x in links)
        out.append((len(a), len(b), len(groups), len(links), n_best, sum(documents[x] for x in links), digest))
    return out


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def rows_of(df):
    return Counter((r.doc_id, *(r[c] for c in COLUMNS)) for r in df.collect())


def check(spark, docs, chunk):
    table = spark.createDataFrame(
        [(k, t, "x", 1) for k, t in docs], "doc_id bigint, text string, n_a string, row bigint"
    )
    found = rows_of(alignment.align(table, chunk=chunk))
    assert found == Counter((k, *row) for (k, _), row in zip(docs, expected([t for _, t in docs]), strict=True))


ODD = [
    (1, None),
    (2, ""),
    (3, " "),
    (4, "▁word ▁ x"),
    (5, "<|endoftext|> plain <s> and </s> and <unk> <0x41>"),
    (6, "tabs\tand\nlines \n\n  spaces   end  "),
    (7, "naïve café 你好世界 \U0001f600\U0001f468‍\U0001f469 é  　x \x1c\x85 y"),
    (8, "It's we'll they've 'quoted' 12345 3.14 a1b2c3!!!"),
    (9, "It's we'll they've 'quoted' 12345 3.14 a1b2c3!!!"),
    (9, "It's we'll they've 'quoted' 12345 3.14 a1b2c3!!!"),
    (None, "no id"),
    (10, "\r\n" * 30 + "x" * 300 + " " + "\n" * 50),
    (11, "你好世界" * 80),
]


@pytest.mark.parametrize("chunk", [1 << 15, 40, 7])
def test_odd_texts(spark, chunk):
    check(spark, ODD, chunk)


@pytest.mark.parametrize("chunk", [1 << 15, 97])
def test_random_texts(spark, chunk):
    numbers = random.Random(3)
    words = ["Lorem", "ipsum,", "naïve", "привет", "x\ty", "it's", "\n", "  ", "123", "(a)", "ß", "漢字"]
    docs = [(i, " ".join(numbers.choice(words) for _ in range(numbers.randrange(0, 90)))) for i in range(60)]
    docs += [(100 + i, "\n".join(numbers.choice(words) for _ in range(60))) for i in range(10)]
    check(spark, docs, chunk)


def test_long_text_equals_short_path(spark):
    whole = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert rows_of(alignment.align(whole)) == rows_of(alignment.align(whole, chunk=500))


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_compose_is_associative():
    numbers = np.random.default_rng(5)

    def parts():
        a_ends = np.unique(numbers.integers(1, 200, 60))
        b_ends = np.unique(numbers.integers(1, 200, 60))
        a_cut, b_cut = (np.sort(numbers.integers(0, 200, 3)) for _ in range(2))
        for k in range(4):
            a = a_ends[np.searchsorted(a_cut, a_ends) == k]
            b = b_ends[np.searchsorted(b_cut, b_ends) == k]
            yield alignment.fragment(alignment.Stream(a, a, b, b))

    def same(x, y):
        return x.cut == y.cut and all(
            np.array_equal(p, q)
            for one, two in ((x.head, y.head), (x.tail, y.tail))
            for p, q in zip(one.columns(), two.columns(), strict=True)
        )

    for _ in range(200):
        (w, wc), (x, xc), (y, yc), (z, zc) = parts()
        wx, c1 = alignment.compose(w, x)
        left, c2 = alignment.compose(wx, y)
        left, c3 = alignment.compose(left, z)
        yz, d1 = alignment.compose(y, z)
        right, d2 = alignment.compose(x, yz)
        right, d3 = alignment.compose(w, right)
        assert same(left, right)
        ends = [np.sort(np.concatenate([s.a for s in (wc, xc, yc, zc, *more)])) for more in ((c1, c2, c3), (d1, d2, d3))]
        assert np.array_equal(*ends)
