"""Operators on documents against their plain definitions, on real and on odd rows."""

import hashlib
import random
import textwrap
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from rubrica.llm import attribution, decontaminate, licenses, line_dedup, ngram_join, packing, quality, suffix_dedup
from rubrica.llm.textblocks import ALNUM, range_hashes, range_sums, word_bounds
from rubrica.llm.tokens import encoder, vocabulary_files

SMALL = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977} tail{i}" for i in range(9000))
PHRASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen."

ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, PHRASE + "\n" + PHRASE),
    (5, PHRASE),
    (6, PHRASE),
    (7, LONG),
    (8, LONG + " end"),
    (9, "été naïve — “quoted” 漢字 🙂 " * 12),
    (10, "a"),
    (11, "A"),
    (12, "Released under the MIT License.\nx = 1; y = 2"),
    (13, "<|endoftext|> one two three four five six seven eight nine ten <|endoftext|>"),
    (14, "ab" * 400),
]
COLUMNS = "doc_id bigint, text string, n_words int, score string, component_id int, key string, tag int, length int"


def frame(spark, rows):
    return spark.createDataFrame([(k, t, 0, "s", -1, "k", 9, 1) for k, t in rows], COLUMNS)


@pytest.fixture(scope="module")
def real(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    return docs, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD), ODD


@pytest.fixture(params=["real", "odd"])
def case(request):
    return request.getfixturevalue(request.param)


# --- repeated byte strings ------------------------------------------------------------------


def found_bytes(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_repeats(case):
    docs, rows = case
    assert found_bytes(suffix_dedup.remove(docs)) == brute.removed_bytes(rows, 100)


def test_repeats_of_frequent_anchors_and_small_shards(real, monkeypatch):
    docs, rows = real
    monkeypatch.setattr(suffix_dedup, "HOT_SPANS", 2)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 500)
    assert found_bytes(suffix_dedup.remove(docs)) == brute.removed_bytes(rows, 100)


def test_repeats_with_repeated_and_null_ids(spark):
    rows = [(None, PHRASE * 2), (5, PHRASE * 2), (5, PHRASE * 2), (5, "x" + PHRASE * 2)]
    out = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in suffix_dedup.remove(frame(spark, rows)).collect())
    n = len(PHRASE) * 2
    assert out[0] == (0, n, 0) and out[1:] == [(5, n, n), (5, n, n), (5, n + 1, n)]


def test_a_document_that_is_loaded_twice_keeps_its_text(spark):
    rows = [(5, PHRASE * 2), (5, PHRASE * 2), (None, LONG), (None, LONG), (7, LONG[:500])]
    out = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in suffix_dedup.remove(frame(spark, rows)).collect())
    n = len(PHRASE) * 2
    assert out == [(0, len(LONG), 0), (0, len(LONG), 0), (5, n, 0), (5, n, 0), (7, 500, 500)]


def test_repeat_groups_hold_all_occurrences():
    random.seed(3)
    text = "".join(random.choice("ab") for _ in range(300)).encode()
    n, length = len(text), 6
    starts = np.arange(n - length + 1)
    left = np.array([-1, *text[: len(starts) - 1]])
    found = suffix_dedup.repeat_groups(
        np.frombuffer(text, np.uint8), starts, np.full(len(starts), n), starts, left, length
    )
    covered = bytearray(n)
    for later, first, common in found:
        assert first < later and text[first : first + common] == text[later : later + common]
        covered[later : later + common] = b"\1" * common
    assert sum(covered) == brute.removed_bytes([(0, text.decode())], length)[0][1]


# --- packing ---------------------------------------------------------------------------------


def test_packing(case):
    docs, rows = case
    out = packing.pack(docs, with_ids=True).collect()
    coder = encoder(vocabulary_files())
    pieces = {}
    for r in out:
        pieces.setdefault(r.doc_id, []).append(r)
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length and 0 < r.length <= 2048
    for key, text in rows:
        own = sorted(pieces[key], key=lambda r: r.piece)
        ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in own])
        assert ids.tolist() == [*coder.whole.encode(text or "", add_special_tokens=False).ids, 0]
        assert [r.piece for r in own] == list(range(len(own)))
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own[:-1])]).tolist()
        assert all(r.length == 2048 for r in own[1:])
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for members in bins.values():
        ends = np.cumsum([n for _, n in sorted(members)])
        assert ends[-1] <= 2048 and [o for o, _ in sorted(members)] == [0, *ends[:-1].tolist()]
    least = -(-sum(r.length for r in out) // 2048)
    assert len(bins) <= least + 1


def test_local_search_empties_bins():
    counts = {6: 2, 5: 2, 4: 1, 3: 3, 2: 1}
    before = packing.best_fit(counts, 12)
    start = {(6, 2): 1, (5, 3): 1, (5, 3, 3): 1, (6,): 1, (4,): 1}
    after = packing.improve(start, 12)
    assert sum(after.values()) < sum(start.values())
    for kinds in (before, after):
        assert all(sum(k) <= 12 for k in kinds)
        assert sum(sum(k) * n for k, n in kinds.items()) == sum(s * n for s, n in counts.items())


def test_packing_of_nothing(spark):
    assert packing.pack(frame(spark, [])).isEmpty()


# --- shingle join ----------------------------------------------------------------------------


def joined(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_shingle_join(case):
    docs, rows = case
    assert joined(ngram_join.join(docs)) == brute.jaccard_components(rows)


def near_copies():
    random.seed(5)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for k in range(60):
        words = list(base)
        for _ in range(k % 4):
            words[random.randrange(80)] = f"x{k}"
        rows.append((k, " ".join(words)))
    common = " ".join(f"c{i}" for i in range(12))
    return rows + [(100 + k, common + " " + " ".join(f"u{k}-{i}" for i in range(20))) for k in range(40)]


def test_shingle_join_in_large_tiles(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SMALL_TILE", 3)
    monkeypatch.setattr(ngram_join, "FREQUENT", 5)
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rows = near_copies()
    docs = frame(spark, rows)
    found = ngram_join.join(docs)
    assert joined(found) == brute.jaccard_components(rows)
    kept = {r.doc_id for r in ngram_join.keep_first(docs, found).collect()}
    assert kept == {c for _, c in brute.jaccard_components(rows).values()}


def test_keep_first_with_repeated_and_null_ids(spark):
    docs = frame(spark, [(1, PHRASE), (1, PHRASE), (None, PHRASE), (2, PHRASE)])
    kept = ngram_join.keep_first(docs, ngram_join.join(docs)).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "None"]


# --- decontamination -------------------------------------------------------------------------


def test_decontamination(spark, case):
    docs, rows = case
    items = [
        (1, PHRASE),
        (2, PHRASE),
        (3, "one TWO three"),
        (None, "word1 tail1"),
        (5, None),
        (6, "..."),
        (7, "A"),
    ]
    items += [(r.item_id + 100, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    benchmark = spark.createDataFrame([(k, t, 1) for k, t in items], "item_id bigint, text string, doc_id int")
    found = decontaminate.scan(docs, benchmark)
    assert sorted(map(tuple, decontaminate.report(found).collect())) == brute.contamination(rows, items)
    clean = {r.doc_id for r in decontaminate.clean(docs, benchmark).collect()}
    assert clean == {r[0] for r in brute.contamination(rows, items) if not r[-1]}


def test_benchmark_in_several_tables(spark, odd, monkeypatch):
    docs, rows = odd
    items = [(1, PHRASE), (2, "word3 tail3 word4 tail4"), (3, "two three")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    monkeypatch.setattr(decontaminate, "TABLE_BYTES", 1)
    found = decontaminate.report(decontaminate.scan(docs, benchmark))
    assert sorted(map(tuple, found.collect())) == brute.contamination(rows, items)


# --- lines -----------------------------------------------------------------------------------


def simhash(line):
    """Bits that more than half of the strings of five bytes have, in plain integers."""
    data, whole = line.encode(), (1 << 64) - 1

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & whole
        x = (x ^ x >> 27) * 0x94D049BB133111EB & whole
        return x ^ x >> 31

    votes = [0] * 128
    for i in range(len(data) - 4):
        one = mix(int.from_bytes(data[i : i + 5], "little") * 0x9E3779B97F4A7C15 + 1 & whole)
        both = one | mix(one + 0xD6E8FEB86659FD93 & whole) << 64
        votes = [n + (both >> k & 1) for k, n in enumerate(votes)]
    return sum(1 << k for k, n in enumerate(votes) if 2 * n > max(len(data) - 4, 0))


def test_simhash_of_long_and_short_runs():
    random.seed(2)
    lines = ["", "a", "abcd", "abcde", *("".join(random.choice("abcé ") for _ in range(n)) for n in (200, 257, 258, 700, 3000))]
    data = [x.encode() for x in lines]
    ends = np.cumsum([len(x) for x in data])
    found = line_dedup.simhashes(np.frombuffer(b"".join(data), np.uint8), ends - [len(x) for x in data], ends)
    for x, row in zip(lines, found):
        plain = simhash(x)
        assert row.tobytes() == plain.to_bytes(16, "little")


def expected_lines(rows):
    limits = line_dedup.DISTANCE, line_dedup.SIMILARITY, line_dedup.MIN_WORDS
    return brute.removed_lines(rows, simhash, line_dedup.edit_distance, *limits)


def check_lines(docs, rows):
    decided = line_dedup.decide(docs)
    expected = expected_lines(rows)
    out = {r.doc_id: r for r in line_dedup.report(docs, decided).collect()}
    assert {k: r.removed for k, r in out.items()} == {k: ",".join(map(str, expected.get(k, []))) for k, _ in rows}
    texts = {r.doc_id: r.text for r in line_dedup.apply(docs, decided).collect()}
    for key, text in rows:
        lines = (text or "").split("\n")
        kept = [x for i, x in enumerate(lines) if i not in set(expected.get(key, []))]
        if key not in expected:
            assert texts[key] == text
        elif any(x.strip() for x in kept):
            assert texts[key] == "\n".join(kept)
        else:
            assert key not in texts


def fuzzy_lines():
    random.seed(2)
    base = [f"token{i}" for i in range(70)]
    rows = []
    for k in range(40):
        words = list(base)
        if k % 3:
            words[random.randrange(70)] = "q" * (k % 5 + 1)
        rows.append((k, f"own line number {k} of {k * 7}\n" + " ".join(words)))
    return rows


def test_lines(case):
    check_lines(*case)


@pytest.mark.parametrize("cell, tile", [(32, 20_000), (2, 20_000), (2, 0)])
def test_near_lines(spark, monkeypatch, cell, tile):
    monkeypatch.setattr(line_dedup, "SMALL_CELL", cell)
    monkeypatch.setattr(line_dedup, "TILE_LINES", tile)
    rows = fuzzy_lines()
    assert expected_lines(rows)
    check_lines(frame(spark, rows), rows)


def changed_lines():
    """Lines of 6 to 60 words and a copy of each with up to a sixth of the words replaced, as plain similarity has it."""
    random.seed(4)
    rows = []
    for k in range(300):
        words = [f"{random.choice('abcdefghij')}{random.randrange(10**6):x}" for _ in range(random.randint(6, 60))]
        other = list(words)
        for _ in range(max(1, len(words) // 6)):
            other[random.randrange(len(words))] = f"z{random.randrange(10**5):x}"
        a, b = " ".join(words), " ".join(other)
        if a != b and 5 * brute.edit_distance(a, b) <= max(len(a), len(b)):
            rows += [(2 * k, a), (2 * k + 1, b)]
    return rows


def test_near_lines_of_all_lengths_against_plain_edit_similarity(spark):
    rows = changed_lines()
    decided = {r.key for r in line_dedup.decide(frame(spark, rows)).collect()}
    assert not {k for k in decided if k % 2 == 0}
    assert len(rows) > 300 and len(decided) >= 0.98 * len(rows) / 2


def test_similarity_of_exactly_four_fifths():
    assert line_dedup.similar("a b c", "a b c"[:4]) and not line_dedup.similar("abcd", "abc")


def test_edit_distance():
    random.seed(1)
    for _ in range(300):
        a, b = ("".join(random.choice("abé") for _ in range(random.randint(0, 12))) for _ in range(2))
        assert line_dedup.edit_distance(a, b) == brute.edit_distance(a, b)


def test_pairs_side_by_side():
    random.seed(6)
    pairs = [("", ""), ("", "a"), ("a", "a"), ("ab", "é𝄞")]
    for n in (3, 20, 63, 64, 65, 128, 129, 200):
        for share in (0.1, 0.2, 0.25):
            for letters in ("ab", "abcdefgh 𝄞é"):
                a = "".join(random.choice(letters) for _ in range(n))
                b = "".join(
                    random.choice((c + "x", "", random.choice(letters))) if random.random() < share else c for c in a
                )
                pairs += [(a, b), (b, a)]
    distances = [brute.edit_distance(*p) for p in pairs]
    want = [5 * d <= max(map(len, p)) for d, p in zip(distances, pairs)]
    for cap in (len(pairs), 5):
        for at in range(0, len(pairs), cap):
            a, b = zip(*pairs[at : at + cap])
            assert line_dedup.similar_pairs(list(a), list(b)).tolist() == want[at : at + cap]
    middle = [(*sorted(p, key=len), d) for p, d in zip(pairs, distances) if 64 < min(map(len, p)) <= 128]
    short, long, expected = zip(*middle)
    assert line_dedup._distances(list(short), list(long), 2)[0].tolist() == list(expected)
    assert line_dedup.similar_pairs(["x" * 2200], ["x" * 2199 + "y"]).all()


def test_sketches_never_part_similar_lines():
    random.seed(7)
    lines = []
    for n in (1, 5, 40, 64, 65, 90, 200, 330, 700, 1500):
        for letters in ("ab", "abcdefgh 𝄞é", "etaoin shrdlu"):
            for share in (0.05, 0.15, 0.2, 0.5):
                a = "".join(random.choice(letters) for _ in range(n))
                b = "".join(
                    random.choice((c + "x", "", random.choice(letters))) if random.random() < share else c for c in a
                )
                lines += [(a, b, sum(x != y for x, y in zip(a, b))), ("é" + a, a[1:], 0)]
    short, long = ([f(x[:2], key=len) for x in lines] for f in (min, max))
    long = [y if x is not y else z[1] for x, y, z in zip(short, long, lines)]
    sizes = [np.array([len(x) for x in texts]) for texts in (short, long)]
    held, first = line_dedup.sketches(short + long)
    gone = line_dedup.apart(held, first[: len(short)], first[len(short) :], *sizes)
    # Several of each length, so that they are compared side by side.
    many = np.tile(np.arange(len(short)), 40)
    at, other = first[: len(short)][many], first[len(short) :][many]
    often = line_dedup.apart(held, at, other, sizes[0][many], sizes[1][many])[: len(short)]
    distances = np.array([line_dedup.edit_distance(a, b) for a, b in zip(short, long)])
    near = 5 * distances <= sizes[1]
    assert near.any() and often.any() and not (gone & near).any() and not (often & near).any()


def test_large_tile_gives_few_pairs_that_are_not_similar():
    random.seed(8)
    parts = ["que", "mente", "ción", "de ", "los ", "ar ", "es", "la ", "adora ", "tu", "osa ", "in", "fi ", "bre", "ru "]
    weights = [6, 6, 6, 6, 4, 4, *[3] * 9]
    lines = ["".join(random.choices(parts, weights, k=random.randint(90, 110))) for _ in range(300)]
    lines += [x.replace("mente", "mento", 1) + "s" for x in lines[:20]]
    data = [x.encode() for x in lines]
    ends = np.cumsum([len(x) for x in data])
    sims = line_dedup.simhashes(np.frombuffer(b"".join(data), np.uint8), ends - [len(x) for x in data], ends)
    sizes = np.array([len(x) for x in lines])
    held, first = line_dedup.sketches(lines)
    cuts = [*first.tolist(), len(held)]
    columns = {
        "tile": np.zeros(len(lines), np.int64),
        "sim": sims[:, 0].view(np.int64),
        "sim2": sims[:, 1].view(np.int64),
        "size": sizes.astype(np.int32),
        "id": np.arange(len(lines)),
        "component": np.arange(len(lines)),
        "sketch": pa.array([held[x:y].tobytes() for x, y in zip(cuts, cuts[1:])], pa.binary()),
    }
    found = set()
    for out in line_dedup._second_pass([pa.RecordBatch.from_pydict(columns)]):
        found |= set(zip(*out.to_pydict().values()))
    near = [(i, j) for x in line_dedup._all_pairs(sims.T, sizes) for i, j in zip(*(y.tolist() for y in x))]
    similar = {(min(p), max(p)) for p in near if line_dedup.similar(lines[p[0]], lines[p[1]])}
    assert len(similar) >= 15 and similar <= found
    assert len(near) > 1000 and len(found) < len(near) / 10


def test_strings_at_other_places_make_no_pairs(spark):
    random.seed(9)
    rows = []
    for k in range(30):
        halves = ["".join(random.choices("abcdefgh ", k=100)).strip() for _ in range(2)]
        rows += [(2 * k, " ".join(halves)), (2 * k + 1, " ".join(halves[::-1]))]
    # Near lines whose strings come twice.
    rows += [(100 + k, "once upon a time " * 5 + f"there was number {k}") for k in range(2)]
    found = line_dedup._lines(line_dedup._texts(frame(spark, rows), "doc_id", "text"))
    batch = found.withColumnRenamed("key", "id").select("id", "sim", "sim2", "size", "keys").toArrow().combine_chunks().to_batches()
    tiles = pa.Table.from_batches(line_dedup._tabled(False)(batch)).sort_by([("tile", "ascending"), ("id", "ascending")])
    pairs = pa.Table.from_batches(line_dedup._first_pass(tiles.combine_chunks().to_batches())).to_pylist()
    assert {(x["a"], x["b"]) for x in pairs} == {(100, 101)}


def test_tiles_of_all_sizes_in_batches_of_all_sizes():
    random.seed(10)
    rows = []
    for tile in range(60):
        bits = [random.getrandbits(63) for _ in range(2)]
        for _ in range(random.choice((1, 2, 3, 8, line_dedup.SMALL_CELL, line_dedup.SMALL_CELL + 1, 90))):
            low, high = sorted(random.choice((0, 100, 140, 255)) for _ in range(2))
            sims = [x ^ random.getrandbits(63) & random.getrandbits(63) & random.getrandbits(63) for x in bits]
            rows.append((tile - 30 << 16 | low << 8 | high, *sims, random.randint(80, 110), len(rows)))
    columns = [np.array(x) for x in zip(*rows)]
    names = ["tile", "sim", "sim2", "size", "id"]
    pairs, again = set(), {}
    for x, y in ((x, y) for x in rows for y in rows if x[0] >> 16 == y[0] >> 16 and x[4] < y[4]):
        size = max(x[3], y[3])
        places = [[n * part / 255 for part in (tile >> 8 & 255, tile & 255)] for tile, *_, n, _ in (x, y)]
        before = max(places[0][0] - places[1][1], places[1][0] - places[0][1], 0)
        ends = [[n - place for place in own] for own, n in zip(places, (x[3], y[3]))]
        behind = max(ends[0][1] - ends[1][0], ends[1][1] - ends[0][0], 0)
        bits = (x[1] ^ y[1]).bit_count() + (x[2] ^ y[2]).bit_count()
        if bits <= line_dedup.DISTANCE and 5 * max(before + behind, abs(x[3] - y[3])) <= size + 1e-9:
            pairs.add((x[4], y[4]))
    counts = np.unique(columns[0] >> 16, return_counts=True)
    small = {t for t, n in zip(*counts) if n <= line_dedup.SMALL_CELL}
    want = {(a, b) for a, b in pairs if rows[a][0] >> 16 in small}
    for step in (1, 7, 100, len(rows)):
        batches = [
            pa.RecordBatch.from_arrays([pa.array(c[at : at + step]) for c in columns], names=names)
            for at in range(0, len(rows), step)
        ]
        found = pa.Table.from_batches(line_dedup._first_pass(batches)).to_pylist()
        again = {x["a"]: x["tile"] for x in found if x["b"] is None}
        assert again == {i: r[0] for i, r in enumerate(rows) if r[0] >> 16 not in small}
        made = {(x["a"], x["b"]) for x in found if x["b"] is not None}
        assert want and {(a, b) for a, b in made if rows[a][0] >> 16 in small} == want and made <= pairs


def test_distances_near_the_diagonal():
    random.seed(11)
    pairs = []
    for n in (65, 100, 130, 200, 300):
        for share in (0.02, 0.1, 0.2, 0.6):
            a = "".join(random.choice("abcdé") for _ in range(n))
            pairs.append((a, "".join(random.choice((c + "x", "", "y")) if random.random() < share else c for c in a)))
    words = max(-(-len(a) // 64) for a, _ in pairs)
    short, long = zip(*(sorted(p, key=len) for p in pairs))
    want = np.array([brute.edit_distance(*p) for p in pairs])
    shift = max(len(y) - len(x) for x, y in zip(short, long))
    for reach in (shift, shift + 10, shift + 64, 500):
        found = line_dedup._distances(list(short), list(long), words, reach)[0]
        assert (found >= want).all() and (found == want)[want <= reach].all()


def test_lines_of_nothing(spark):
    docs = frame(spark, [])
    assert line_dedup.apply(docs, line_dedup.decide(docs)).isEmpty()


# --- token counts ----------------------------------------------------------------------------


def test_token_counts_add_up(case):
    docs, rows = case
    coder = encoder(vocabulary_files())
    for rule in attribution.RULES:
        out = {}
        for r in attribution.count_tokens(docs, rule=rule).collect():
            out.setdefault(r.doc_id, []).append(r)
        for key, text in rows:
            own = sorted(out[key], key=lambda r: r.section)
            text = text or ""
            assert sum(r.n_tokens for r in own) == len(coder.ids(text))
            assert "".join(text[r.start_char : r.end_char] for r in own) == text


def test_boundary_rules():
    widths, bounds = np.array([2, 5, 3]), np.array([0, 3, 6, 10])
    assert attribution.allocate(widths, bounds, "first")[0].tolist() == [2, 0, 1]
    assert attribution.allocate(widths, bounds, "last")[0].tolist() == [1, 0, 2]
    assert attribution.allocate(widths, bounds, "largest")[0].tolist() == [1, 1, 1]
    assert attribution.allocate(np.array([4]), np.array([0, 2, 4]), "largest")[0].tolist() == [1, 0]


def test_fields(spark):
    docs = spark.createDataFrame([(1, "title", "body text\nmore"), (2, None, "x")], "doc_id int, a string, b string")
    out = attribution.count_tokens(docs, fields=("a", "b")).orderBy("doc_id", "section").collect()
    assert [(r.doc_id, r.field) for r in out] == [(1, "a"), (1, "b"), (1, "b"), (2, "a"), (2, "b")]


# --- licences --------------------------------------------------------------------------------


def test_licences(spark):
    full = "\n".join(licenses.SENTENCES[s] for s in ("mit-grant", "mit-notice", "mit-warranty"))
    header = " ".join(licenses.SENTENCES[s] for s in ("apache-under", "apache-comply"))
    rows = [
        (1, None),
        (2, ""),
        (3, "Copyright 2020. " + full),
        (4, "// " + header + " More text. RELEASED under the MIT license."),
        (5, "Some text. Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0."),
        (6, licenses.SENTENCES["mit-notice"]),
    ]
    out = {r.doc_id: r for r in licenses.report(licenses.scan(frame(spark, rows))).collect()}
    assert [out[k].licences for k in range(1, 7)] == ["", "", "MIT", "Apache-2.0,MIT", "CC-BY-NC-4.0", ""]
    assert [out[k].n_matches for k in range(1, 7)] == [0, 0, 1, 2, 2, 0]
    assert out[6].n_known == 1 and out[1].n_sentences == 0


def wrapped(*names, mark=""):
    known = licenses.SENTENCES | licenses.MORE_SENTENCES
    lines = [x for n in names for x in [*textwrap.wrap(known[n], 72), ""]]
    return "\n".join((mark + x).rstrip() for x in lines)


def test_wrapped_and_commented_licences(spark):
    texts = {
        "MIT": wrapped("mit-grant", "mit-notice", "mit-warranty"),
        "BSD-3-Clause": wrapped("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", mark=" * "),
        "ISC": "// Copyright 2020 Somebody\n" + wrapped("isc-grant", mark="// "),
        "Apache-2.0": wrapped("apache-under", "apache-comply", "apache-copy", "apache-basis", mark="# "),
        "GPL-3.0-or-later": wrapped("gpl-free-comma", "gpl-hope", mark="; "),
        "GPL-2.0-or-later": "\n".join(
            textwrap.wrap(" ".join(licenses.SENTENCES[n] for n in ("gpl-free-semicolon", "gpl2-terms", "gpl2-later")), 60)
        ),
        "LGPL-2.1-or-later": wrapped("lgpl-free", "lgpl-terms", "lgpl21-later", mark="dnl "),
        "AGPL-3.0-or-later": wrapped("agpl3-free", mark="-- "),
        "LGPL-3.0-or-later": wrapped("lgpl3-free").replace("\n", "\r\n"),
        "MPL-2.0": wrapped("mpl2") + "2.0. If a copy was not distributed",
        "Unlicense": wrapped("unlicense"),
    }
    bullets = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided "
    bullets += "that the following conditions\nare met:\n1. " + "\n2. ".join(
        "\n   ".join(textwrap.wrap(licenses.SENTENCES[n], 66)) for n in ("bsd-source", "bsd-binary")
    )
    rows = [*enumerate(texts.values()), (50, bullets), (51, "\n".join("* " * 5000 for _ in range(3)))]
    out = {r.doc_id: r for r in licenses.report(licenses.scan(frame(spark, rows))).collect()}
    assert [out[k].licences for k, _ in enumerate(texts)] == list(texts)
    assert out[50].licences == "BSD-2-Clause" and out[51].licences == ""
    assert {r.n_matches for r in out.values() if r.licences} == {1}


def test_licences_need_no_shuffle_and_no_python(spark, plan_of):
    plan = plan_of(licenses.report(licenses.scan(frame(spark, ODD))))
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


# --- quality ---------------------------------------------------------------------------------


def test_quality_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fit(docs, labels)
    out = quality.report(quality.score(docs, model)).join(labels, "doc_id").where("held_out").collect()
    assert len(out) > 50
    assert sum(r.predicted == r.quality for r in out) / len(out) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    kept = {r.doc_id for r in quality.accepted(docs, model).collect()}
    assert {r.doc_id for r in out if r.predicted} <= kept and not kept & {r.doc_id for r in out if not r.predicted}


def test_quality_of_odd_rows(spark, odd):
    docs, rows = odd
    labels = spark.createDataFrame(
        [(k, k % 2, 5) for k, _ in rows] + [(4, None, 5), (None, 1, 5)], "doc_id bigint, quality int, text int"
    )
    scored = quality.report(quality.score(docs, quality.fit(docs, labels))).collect()
    assert sorted(r.doc_id for r in scored) == [k for k, _ in rows]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in scored)
    none = quality.fit(docs, labels.where("false"))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}


def test_attention_gradient():
    random_numbers = np.random.default_rng(0)
    x = random_numbers.normal(size=(7, quality.N_FEATURES))
    first, y = np.array([0, 3]), np.array([0.0, 1.0])
    h, a = quality.HIDDEN, quality.ATTENTION
    shapes = {"w": (quality.N_FEATURES, h), "b": (h,), "v": (h, a), "u": (h, a), "a": (a,), "c": (h,), "d": ()}
    p = {k: random_numbers.normal(0, 0.1, s) for k, s in shapes.items()}

    def loss(q):
        score, _ = quality._forward(q, x, first)
        penalty = quality.DECAY / 2 * ((q["w"] ** 2).sum() + (q["c"] ** 2).sum())
        return -(y * np.log(score) + (1 - y) * np.log(1 - score)).mean() + penalty

    gradient = quality._gradient(p, x, first, y)
    for k in shapes:
        step = random_numbers.normal(size=shapes[k])
        ahead, behind = ({**p, k: p[k] + e * step} for e in (1e-5, -1e-5))
        assert np.isclose((loss(ahead) - loss(behind)) / 2e-5, np.sum(gradient[k] * step), atol=1e-6)


def test_empty_tables(spark):
    docs = frame(spark, [])
    benchmark = spark.createDataFrame([], "item_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert suffix_dedup.remove(docs).isEmpty()
    assert ngram_join.join(docs).isEmpty()
    assert decontaminate.scan(docs, benchmark).isEmpty()
    assert quality.score(docs, quality.fit(docs, labels)).isEmpty()
    assert attribution.count_tokens(docs).isEmpty()
    assert licenses.scan(docs).isEmpty()
    full = frame(spark, ODD)
    assert decontaminate.report(decontaminate.scan(full, benchmark)).agg({"n_hit": "sum"}).first()[0] == 0


def test_sha256_of_no_items(spark):
    docs = frame(spark, [(1, None)])
    benchmark = spark.createDataFrame([(1, PHRASE)], "item_id bigint, text string")
    row = decontaminate.report(decontaminate.scan(docs, benchmark)).first()
    assert row.items_sha256 == hashlib.sha256(b"").hexdigest() and row.n_words == 0
