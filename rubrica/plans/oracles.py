"""The registered queries as SQL for DuckDB, written from the rules and not from the plans.

Differences of dialect: RE2 has no look-around, so word neighbours are captured and adjacent
hits need further passes; numbers are written with an exponent to make them doubles.
"""

from __future__ import annotations

from rubrica.config import NUMBER_WORDS

WORD = r"\p{L}\p{N}_"
SPACE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
TAGS = r"\[pause\]|\[cough\]|\[laugh\]|\[gibberish\]|\[en inglés\]"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
IGNORED = "info|instruction|instructions|stimuli|key|rubric|scores|participant information|metadata"
PUNCTUATION = r"""!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~"""
LEXICAL = (
    "lemma_recall, idea_unit_recall, lemma_precision, idea_unit_precision, "
    "stimulus_lemma_count, response_lemma_count, stimulus_idea_count, response_idea_count"
)


def replace_all(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, '{pattern}', '{by}', 'g')"


def r4(x: str) -> str:
    """Python's round(x, 4): the double in two halves, exact distance to the tie, ties to even."""
    split = f"({x} * 134217729e0)"
    high = f"({split} - ({split} - {x}))"
    down = f"floor({x} * 1e4)"
    over = f"((({high} * 1e4 - {down}) - 5e-1) + ({x} - {high}) * 1e4)"
    return (
        f"(({down} + CASE WHEN {over} > 0 OR ({over} = 0 AND {down} % 2 <> 0) THEN 1e0 ELSE 0e0 END) / 1e4)"
    )


def strip(x: str) -> str:
    return replace_all(x, f"^[{SPACE}]+|[{SPACE}]+$", "")


def suffix_off(x: str) -> str:
    return strip(replace_all(x, rf"[{SPACE}]*\(\p{{Nd}}+\)[{SPACE}]*$", ""))


def clean(x: str, lower: bool = True, accents_off: bool = True) -> str:
    out = f"coalesce({x}, '')"
    out = f"lower({out})" if lower else out
    out = replace_all(out, f"(?i){TAGS}", " ")
    for _ in range(2):
        out = replace_all(out, f"(?i)(^|[^{WORD}])(?:xxx|xx|x)($|[^{WORD}])", r"\1 \2")
    for _ in range(3):
        out = replace_all(out, f"(^|[^{WORD}])[{WORD}]+-[{SPACE}]+([{WORD}])", r"\1\2")
    out = replace_all(out, f"[^{WORD}]+", " ")
    out = f"strip_accents({out})" if accents_off else out
    return replace_all(f"trim({out})", r"^[^\p{L}\p{N}]*$", "")


SHEET_ROWS = r"""
items AS (
  SELECT doc_id, lang, source, s, unnest(s) AS sent, generate_subscripts(s, 1) - 1 AS pos
  FROM (SELECT doc_id, lang, source, regexp_split_to_array(text, '[.!?\n]+') AS s FROM documents)
),
variants AS (
  SELECT *, s[pos + 2] AS other, length(sent) AS len, (doc_id + pos) % 8 AS v FROM items
),
all_rows AS (
  SELECT 0 AS sheet_ordinal,
    CASE source WHEN 'src7' THEN 'Answer Key ' WHEN 'src13' THEN 'Info ' ELSE 'Participant ' END
      || doc_id || '_' || lang AS sheet_name,
    pos AS row_ordinal,
    sent || ' (' || len || ')' AS stimulus,
    CASE v WHEN 0 THEN sent WHEN 1 THEN '[cough] ' || sent || '!' WHEN 2 THEN '[pause] xxx'
      WHEN 3 THEN substr(sent, 1, len * 7 // 10) WHEN 4 THEN 'dis- ' || sent
      WHEN 5 THEN substr(sent, 1, len * 3 // 10) WHEN 6 THEN other ELSE '   ' END AS transcription,
    CASE WHEN v IN (0, 4) THEN '4' WHEN v = 1 THEN '4.0' WHEN v = 2 THEN '0'
      WHEN v = 3 THEN CASE len % 5 WHEN 0 THEN '7' WHEN 1 THEN '3' || chr(9) WHEN 2 THEN chr(10) || '3'
        WHEN 3 THEN chr(160) || '3' ELSE ' 3 ' END
      WHEN v = 5 AND len % 7 = 0 THEN 'n/a' WHEN v = 5 THEN '1.9' WHEN v = 6 THEN '2' END AS human_score
  FROM variants
),
sheet_rows AS (
  SELECT * FROM all_rows WHERE NOT regexp_matches(lower(trim(sheet_name)), '""" + IGNORED + r"""')
)"""


def _number(cell: str) -> str:
    return f"CASE WHEN regexp_matches({cell}, '{NUMBER}') THEN TRY_CAST({cell} AS DOUBLE) END"


def number(x: str) -> str:
    """ASCII white space around a number is skipped."""
    return _number(f"trim({x}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")


def label(x: str) -> str:
    """Any white space around a label is skipped."""
    return f"CAST(trunc({_number(strip(x))}) AS INTEGER)"


def participant(x: str) -> str:
    return f"""CASE WHEN regexp_extract({x}, '\\d+') <> '' THEN 'P' || regexp_extract({x}, '\\d+')
    WHEN {strip(x)} <> '' THEN {replace_all(strip(x), f'[{SPACE}]+', '_')} ELSE 'unknown_participant' END"""


def flagged(source: str = "sheet_rows", role: str = "tuning") -> str:
    limit = "WHEN human_score < 0 OR human_score > 4 THEN 'out_of_range'" if role == "tuning" else ""
    return f"""
typed AS (
  SELECT {participant('sheet_name')} AS participant_id, sheet_name, row_ordinal,
    {strip('stimulus')} AS stimulus, {strip('transcription')} AS transcription,
    {number('human_score')} AS human_score
  FROM {source}
),
flagged AS (
  SELECT participant_id, sheet_name, row_ordinal, {suffix_off('stimulus')} AS stimulus, transcription, human_score,
    CASE WHEN stimulus IS NULL OR transcription IS NULL THEN 'missing'
      WHEN stimulus = '' OR transcription = '' THEN 'blank' {limit} END AS reason
  FROM typed
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY participant_id, sheet_name, stimulus, transcription
                               ORDER BY row_ordinal) AS copy
  FROM flagged WHERE reason IS NULL
),
pairs AS (
  SELECT participant_id, sheet_name, row_ordinal, stimulus, transcription, human_score
  FROM ranked WHERE copy = 1 {"AND human_score IS NOT NULL" if role == "tuning" else ""}
)"""


def gated(source: str) -> str:
    return f"""
texts AS (
  SELECT *, {clean('stimulus')} AS clean_stimulus, {clean('transcription')} AS clean_response FROM {source}
),
cleaned AS (
  SELECT *, CASE WHEN clean_response = '' THEN 0 WHEN clean_stimulus = clean_response THEN 4 END AS early_gate_score
  FROM texts
)"""


CLEANED = f"""{SHEET_ROWS},
named AS (
  SELECT sheet_name, row_ordinal, {suffix_off('stimulus')} AS stimulus, transcription,
    {label('human_score')} AS human_score
  FROM sheet_rows
),{gated('named')}"""


_LOW = "4294967295::UBIGINT"


def _turned(x: str, bits: int) -> str:
    """A 32-bit number rotated to the left."""
    return f"((({x} << {bits}) & {_LOW}) | ({x} >> {32 - bits}))"


def _times(x: str, factor: int) -> str:
    return f"(({x} * {factor}::UBIGINT) & {_LOW})"


def hashed_words(texts: str) -> str:
    """``unit (t, bucket, v)``: unit vectors of word counts over 256 buckets of a 32-bit word hash (MurmurHash3, seed 42)."""
    mixed = _times(_turned(_times("k", 0xCC9E2D51), 15), 0x1B873593)
    step = f"(({_turned('xor(h, k)', 13)} * 5::UBIGINT + {0xE6546B64}::UBIGINT) & {_LOW})"
    return f"""
terms AS (SELECT t, w, count(*) AS n FROM (SELECT t, unnest(string_split(t, ' ')) AS w FROM ({texts})) GROUP BY ALL),
coded AS (
  SELECT w, hex(encode(w)) AS code, octet_length(encode(w)) AS len FROM (SELECT DISTINCT w FROM terms)
),
raw_bytes AS (SELECT w, len, [('0x' || substr(code, 2 * i + 1, 2))::UBIGINT FOR i IN range(len)] AS b FROM coded),
blocks AS (
  SELECT w, len, [b[4 * i + 1] + b[4 * i + 2] * 256 + b[4 * i + 3] * 65536 + b[4 * i + 4] * 16777216 FOR i IN range(len // 4)] AS ks,
    coalesce(b[len // 4 * 4 + 1], 0) + coalesce(b[len // 4 * 4 + 2], 0) * 256 + coalesce(b[len // 4 * 4 + 3], 0) * 65536 AS k
  FROM raw_bytes
),
mixed AS (SELECT w, len, {mixed} AS tail, [42::UBIGINT] || [{mixed} FOR k IN ks] AS ks FROM blocks),
folded AS (SELECT w, xor(xor(list_reduce(ks, lambda h, k: {step}), tail), len::UBIGINT) AS a FROM mixed),
once AS (SELECT w, {_times('xor(a, a >> 16)', 0x85EBCA6B)} AS a FROM folded),
twice AS (SELECT w, {_times('xor(a, a >> 13)', 0xC2B2AE35)} AS a FROM once),
buckets AS (SELECT w, CAST(xor(a, a >> 16) & 255 AS INTEGER) AS bucket FROM twice),
counted_words AS (SELECT t, bucket, sum(n)::DOUBLE AS n FROM terms JOIN buckets USING (w) GROUP BY ALL),
unit AS (SELECT t, bucket, (n / sqrt(sum(n * n) OVER (PARTITION BY t)))::FLOAT AS v FROM counted_words)"""


def hashed_cosine(pairs: str) -> str:
    """``similar_pairs``: the distinct text pairs of a table with ``sbert_similarity``."""
    texts = f"SELECT DISTINCT unnest([clean_stimulus, clean_response]) AS t FROM {pairs}"
    return f"""{hashed_words(texts)},
dots AS (
  SELECT p.clean_stimulus, p.clean_response, least(1e0, greatest(0e0, coalesce(sum(a.v::DOUBLE * b.v::DOUBLE ORDER BY a.bucket), 0e0))) AS d
  FROM {pairs} p JOIN unit a ON a.t = p.clean_stimulus LEFT JOIN unit b ON b.t = p.clean_response AND b.bucket = a.bucket
  GROUP BY ALL
),
similar_pairs AS (SELECT clean_stimulus, clean_response, {r4('d')} AS sbert_similarity FROM dots)"""


def overlap(source: str, key: str, lexicon: bool) -> str:
    """Overlap features per key, from exploded distinct words."""
    words = ", ".join(f"'{w}'" for w in NUMBER_WORDS)

    def forms(side: str) -> str:
        return f"""SELECT DISTINCT {key}, form, '{side}' AS side
      FROM (SELECT {key}, unnest(string_split({side}, ' ')) AS form FROM {source}
            WHERE clean_stimulus <> '' AND clean_response <> '')
      WHERE regexp_matches(form, '[^\\p{{P}}]') AND NOT regexp_matches(form, '^[\\p{{Nd}}²³¹⁰⁴-⁹₀-₉]+$')
        AND form NOT IN ({words})"""

    lemma = "regexp_replace(form, '(es|s)$', '')" if lexicon else "form"
    idea = "length(form) % 2 = 0 AND length(form) > 3" if lexicon else "FALSE"
    keys = [k.strip() for k in key.split(",")]
    on = " AND ".join(f"b.{k} = c.{k}" for k in keys)
    return f"""
occurrences AS ({forms('clean_stimulus')} UNION ALL {forms('clean_response')}),
lemmas AS (
  SELECT {key}, {lemma} AS lemma,
    bool_or(side = 'clean_stimulus') AS s, bool_or(side = 'clean_response') AS r,
    bool_or(side = 'clean_stimulus' AND {idea}) AS si, bool_or(side = 'clean_response' AND {idea}) AS ri
  FROM occurrences WHERE {lemma} <> '' GROUP BY ALL
),
sums AS (
  SELECT {key}, count(*) FILTER (s) AS ls, count(*) FILTER (r) AS lr, count(*) FILTER (s AND r) AS lb,
    count(*) FILTER (si) AS ids, count(*) FILTER (ri) AS idr, count(*) FILTER (si AND ri) AS ib
  FROM lemmas GROUP BY ALL
),
counted AS (
  SELECT b.*, coalesce(ls, 0) AS ls, coalesce(lr, 0) AS lr, coalesce(lb, 0) AS lb,
    coalesce(ids, 0) AS ids, coalesce(idr, 0) AS idr, coalesce(ib, 0) AS ib
  FROM {source} b LEFT JOIN sums c ON {on}
),
shares AS (
  SELECT *, CASE WHEN ls > 0 THEN lb::DOUBLE / ls ELSE 0e0 END AS q1,
    CASE WHEN ids > 0 THEN ib::DOUBLE / ids ELSE 0e0 END AS q2,
    CASE WHEN lr > 0 THEN lb::DOUBLE / lr ELSE 0e0 END AS q3,
    CASE WHEN idr > 0 THEN ib::DOUBLE / idr ELSE 0e0 END AS q4
  FROM counted
),
features AS (
  SELECT *, {r4('q1')} AS lemma_recall, {r4('q2')} AS idea_unit_recall, {r4('q3')} AS lemma_precision,
    {r4('q4')} AS idea_unit_precision, CAST(ls AS INTEGER) AS stimulus_lemma_count,
    CAST(lr AS INTEGER) AS response_lemma_count, CAST(ids AS INTEGER) AS stimulus_idea_count,
    CAST(idr AS INTEGER) AS response_idea_count
  FROM shares
)"""


RATED = """
rated AS (
  SELECT id, y, status, least(1e0, greatest(0e0, floor((15e-2 * y + 4e-1 * price / 500000e0) * 10000 + 5e-1) / 1e4)) AS raw
  FROM (SELECT o_orderkey AS id, o_totalprice AS price, o_orderstatus AS status,
               5 - CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS y FROM orders)
)"""


def rubric(raw: str, cuts=("2e-1", "4e-1", "6e-1", "85e-2")) -> str:
    lines = " ".join(f"WHEN {raw} < {cut} THEN {i}" for i, cut in enumerate(cuts))
    return f"CASE {lines} ELSE 4 END"


PREDICTED = f"""{RATED},
predicted AS (SELECT id, status, y, raw, {rubric('raw')} AS pred FROM rated)"""

FEATURE_PAIRS = f"""{RATED},
base AS (
  SELECT id, y, raw, CAST(id * 7919 % 1000 AS DOUBLE) / 1000 AS h,
    CASE WHEN id % 3 = 0 AND y IN (0, 4) THEN y END AS g FROM rated
),
with_ent AS (
  SELECT *, floor(least(1e0, greatest(0e0, raw + 2e-1 * (h - 5e-1))) * 10000 + 5e-1) / 1e4 AS ent FROM base
),
with_con AS (SELECT *, floor((1e0 - ent) * 6e-1 * 10000 + 5e-1) / 1e4 AS con FROM with_ent),
feature_pairs AS (
  SELECT id, y AS human_score, g AS early_gate_score,
    CASE WHEN g IS NULL THEN floor((ent - con) * 10000 + 5e-1) / 1e4 END AS nli_margin,
    CASE WHEN g IS NULL THEN ent END AS nli_entailment,
    CASE WHEN g IS NULL THEN con END AS nli_contradiction,
    CASE WHEN g IS NULL THEN floor(least(1e0, 9e-1 * raw + 1e-1 * h) * 10000 + 5e-1) / 1e4 END AS sbert_similarity,
    CASE WHEN g IS NULL THEN floor(raw * 100 + 5e-1) / 1e2 END AS lemma_recall
  FROM with_con
),
weighted AS (
  SELECT *, least(1e0, greatest(0e0, ((0e0 + coalesce(nli_margin, 0e0) * 55e-2)
    + coalesce(sbert_similarity, 0e0) * 3e-1) + coalesce(lemma_recall, 0e0) * 15e-2)) AS w,
    coalesce(nli_margin, 0e0) * 55e-2 AS c1, coalesce(sbert_similarity, 0e0) * 3e-1 AS c2,
    coalesce(lemma_recall, 0e0) * 15e-2 AS c3
  FROM feature_pairs
),
raw_scored AS (SELECT *, {r4('w')} AS heuristic_raw_score FROM weighted),
scored AS (
  SELECT *, coalesce(early_gate_score, {rubric('heuristic_raw_score')}) AS heuristic_pred FROM raw_scored
)"""


def agreement(cells: str, by: str = "") -> str:
    """QWK over positions among present labels, accuracy and macro F1 from cells (t, p, n)."""
    g = by or "g"
    return f"""
cells AS ({cells}),
present AS (SELECT {g}, t AS label FROM cells UNION SELECT {g}, p FROM cells),
placed AS (SELECT {g}, label, row_number() OVER (PARTITION BY {g} ORDER BY label) AS place FROM present),
indexed AS (
  SELECT c.{g}, c.t, c.p, c.n, i.place AS i, j.place AS j FROM cells c
  JOIN placed i ON i.{g} = c.{g} AND i.label = c.t JOIN placed j ON j.{g} = c.{g} AND j.label = c.p
),
by_row AS (SELECT {g}, i, sum(n)::DOUBLE AS m FROM indexed GROUP BY ALL),
by_col AS (SELECT {g}, j, sum(n)::DOUBLE AS m FROM indexed GROUP BY ALL),
sizes AS (SELECT {g}, sum(n)::DOUBLE AS n, sum(n) FILTER (t = p)::DOUBLE AS hits,
                 sum(n * (i - j) * (i - j))::DOUBLE AS observed FROM indexed GROUP BY ALL),
expected AS (
  SELECT r.{g}, sum(r.m * c.m * (r.i - c.j) * (r.i - c.j)) AS e FROM by_row r JOIN by_col c ON c.{g} = r.{g} GROUP BY ALL
),
per_class AS (
  SELECT l.{g}, l.label, coalesce(sum(n) FILTER (t = l.label AND p = l.label), 0)::DOUBLE AS tp,
    coalesce(sum(n) FILTER (t = l.label), 0)::DOUBLE AS rt, coalesce(sum(n) FILTER (p = l.label), 0)::DOUBLE AS rp
  FROM placed l JOIN cells c ON c.{g} = l.{g} GROUP BY ALL
),
f1 AS (SELECT {g}, avg(2e0 * tp / (rt + rp)) AS f FROM per_class GROUP BY ALL),
metrics AS (
  SELECT s.{g}, s.n, CASE WHEN e.e <> 0 THEN 1e0 - s.observed / (e.e / s.n) END AS k,
    coalesce(s.hits, 0) / s.n AS a, f.f
  FROM sizes s JOIN expected e ON e.{g} = s.{g} JOIN f1 f ON f.{g} = s.{g}
),
rounded AS (
  SELECT {g}, CAST(n AS BIGINT) AS n, {r4('k')} AS qwk, {r4('a')} AS accuracy, {r4('f')} AS macro_f1 FROM metrics
)"""


def cells_of(source: str, truth: str, pred: str, by: str = "1 AS g") -> str:
    return (
        f"SELECT {by}, {truth} AS t, {pred} AS p, count(*) AS n FROM {source} "
        f"WHERE {truth} IS NOT NULL AND {pred} IS NOT NULL GROUP BY ALL"
    )


def quotas(stratified: bool, rated: str = RATED) -> str:
    group = "y" if stratified else "0"
    share = (
        """
taken AS (
  SELECT *, row_number() OVER (ORDER BY n * n_train % total DESC, grp) AS place,
    n * n_train // total AS base, n_train - sum(n * n_train // total) OVER () AS missing
  FROM whole
),
quota AS (SELECT grp, n - base - CASE WHEN place <= missing THEN 1 ELSE 0 END AS q FROM taken)"""
        if stratified
        else "quota AS (SELECT grp, total - n_train AS q FROM whole)"
    )
    return f"""{rated},
sizes AS (SELECT {group} AS grp, count(*) AS n FROM rated GROUP BY ALL),
whole AS (
  SELECT grp, n, total, total - CAST(ceil(total * 2e-1) AS BIGINT) AS n_train
  FROM (SELECT grp, n, CAST(sum(n) OVER () AS BIGINT) AS total FROM sizes)
),{share},
placed AS (
  SELECT id, y, {group} AS grp, row_number() OVER (PARTITION BY {group}
    ORDER BY md5('42|' || CAST(id AS VARCHAR)), id) AS place FROM rated
)
SELECT id, y, CASE WHEN place <= q THEN 'validation' ELSE 'train' END AS split
FROM placed JOIN quota USING (grp)"""


HISTOGRAM = f"""{RATED},
histogram AS (SELECT CAST(round(raw * 10000) AS INTEGER) AS bin, y AS label, count(*) AS n FROM rated GROUP BY ALL)"""

_BOUNDS = ((0, 4000), (2000, 7000), (4000, 9000), (6000, 10000))


def _shortest_paths(rounds: int, histogram: str = HISTOGRAM, used=range(5), first: str = "TRUE") -> str:
    """Best cuts of all by rounds of shortest paths.

    Every grade has labels, or all but grade 0: then ``used`` is the grades in use and ``first`` says by ``n0``, the rows that
    get grade 0, whether there may be any.
    """
    place = {grade: i for i, grade in enumerate(used)}
    ctes = [
        histogram,
        "per_bin AS (SELECT bin, "
        + ", ".join(f"sum(n) FILTER (label = {y}) AS n{y}" for y in range(5))
        + " FROM histogram GROUP BY bin)",
        "counted AS (SELECT b.bin, "
        + ", ".join(
            f"coalesce(sum(n{y}) OVER up, 0)::BIGINT AS c{y}, coalesce(sum(n{y}) OVER (), 0)::BIGINT AS a{y}" for y in range(5)
        )
        + " FROM (SELECT unnest(range(10001)) AS bin) b LEFT JOIN per_bin USING (bin)"
        " WINDOW up AS (ORDER BY b.bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))",
    ]

    def apart(prefix: str, grade: int) -> str:
        return " + ".join(f"{prefix}{y} * {(place[y] - place.get(grade, 0)) ** 2}" for y in used)

    columns = []
    for at, prefix in (("", "c"), ("e", "a")):
        rows = " + ".join(f"{prefix}{y}" for y in range(5))
        for g in range(5):
            columns += [
                f"({apart(prefix, g)})::DOUBLE AS {at}o{g}",
                f"({rows})::DOUBLE * ({apart('a', g)})::DOUBLE AS {at}d{g}",
            ]
    ctes += [
        f"sums AS (SELECT bin, {' + '.join(f'c{y}' for y in range(5))} AS n0, {', '.join(columns)}, ({' + '.join(f'a{y}' for y in range(5))})::DOUBLE AS n FROM counted)",
        "round0 AS (SELECT 0e0 AS mu, NULL::DOUBLE AS t1, NULL::DOUBLE AS t2, NULL::DOUBLE AS t3, NULL::DOUBLE AS t4)",
    ]

    def weight(g: int, at: str = "") -> str:
        return f"({at}o{g} - mu * {at}d{g})"

    for r in range(1, rounds + 1):
        low, high = _BOUNDS[0]
        ctes.append(
            f"path{r}_0 AS (SELECT *, CASE WHEN {first} AND bin BETWEEN {low} AND {high} THEN "
            f"{{'cost': {weight(0)}, 't1': bin, 'o': o0, 'd': d0}} END AS path FROM sums, (SELECT mu FROM round{r - 1}))"
        )
        for i in range(1, 4):
            low, high = _BOUNDS[i]
            cuts = ", ".join(f"'t{k}': path.t{k}" for k in range(1, i + 1))
            kept = ", ".join(f"'t{k}': p.t{k}" for k in range(1, i + 1))
            ctes.append(
                f"left{r}_{i} AS (SELECT * EXCLUDE (path), min(CASE WHEN path IS NOT NULL THEN {{'cost': path.cost - {weight(i)}, "
                f"{cuts}, 'o': path.o - o{i}, 'd': path.d - d{i}}} END) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED "
                f"PRECEDING AND 1 PRECEDING) AS p FROM path{r}_{i - 1})"
            )
            ctes.append(
                f"path{r}_{i} AS (SELECT * EXCLUDE (p), CASE WHEN p IS NOT NULL AND bin BETWEEN {low} AND {high} THEN "
                f"{{'cost': p.cost + {weight(i)}, {kept}, 't{i + 1}': bin, 'o': p.o + o{i}, 'd': p.d + d{i}}} END AS path "
                f"FROM left{r}_{i})"
            )
        whole = ", ".join(f"'t{k}': path.t{k}" for k in range(1, 5))
        ctes.append(
            f"best{r} AS (SELECT min({{'cost': path.cost - {weight(4)} + {weight(4, 'e')}, {whole}, "
            f"'o': path.o - o4 + eo4, 'd': path.d - d4 + ed4}}) AS b FROM path{r}_3 WHERE path IS NOT NULL)"
        )
        better = f"{r} = 1 OR b.o / b.d <= mu"
        ctes.append(
            f"round{r} AS (SELECT CASE WHEN {better} THEN b.o / b.d ELSE mu END AS mu, "
            + ", ".join(f"CASE WHEN {better} THEN b.t{k} ELSE t{k} END AS t{k}" for k in range(1, 5))
            + f" FROM best{r}, round{r - 1})"
        )
    return "WITH " + ",\n".join(ctes).lstrip()


_INPUTS = ("nli_margin", "nli_entailment", "nli_contradiction", "sbert_similarity", "lemma_recall")


def _newton(train: str, rounds: int) -> str:
    """Fitted boundary models ``fitted (b, c0 .. c5)`` by Newton steps from zero, systems solved by elimination."""
    size = range(len(_INPUTS) + 1)
    ctes = [
        f"train_rows AS ({train})",
        "x AS (SELECT "
        + ", ".join(f"coalesce({name}, 0e0) AS x{i}" for i, name in enumerate(_INPUTS))
        + ", 1e0 AS x5, human_score AS y FROM train_rows)",
        "bounds AS (SELECT b, count(*)::DOUBLE AS n, count(*) FILTER (y > b)::DOUBLE AS above"
        " FROM x, (SELECT unnest([0, 1, 2, 3]) AS b) GROUP BY b)",
        "sides AS (SELECT b, n / (2e0 * above) AS up, n / (2e0 * (n - above)) AS down FROM bounds)",
        "beta0 AS MATERIALIZED (SELECT *, " + ", ".join(f"0e0 AS c{i}" for i in size) + " FROM sides)",
    ]
    beta = [f"c{i}" for i in size]
    for r in range(rounds):
        score = " + ".join(f"c{i} * x{i}" for i in size)
        matrix = [f"sum(s * x{i} * x{j}){' + 1e0' if i == j < 5 else ''} AS m{i}_{j}" for i in size for j in size]
        right = [f"sum(d * x{i}){f' + any_value(c{i})' if i < 5 else ''} AS m{i}_6" for i in size]
        ctes.append(
            f"weighted{r} AS (SELECT *, w * (p - CASE WHEN y > b THEN 1e0 ELSE 0e0 END) AS d, w * p * (1e0 - p) AS s FROM ("
            f"SELECT *, 1e0 / (1e0 + exp(-({score}))) AS p, CASE WHEN y > b THEN up ELSE down END AS w FROM x, beta{r}))"
        )
        ctes.append(f"step{r}_0 AS MATERIALIZED (SELECT b, {', '.join(matrix + right)} FROM weighted{r} GROUP BY b)")
        for k in size:
            cells = [
                f"m{i}_{j} - m{i}_{k} / m{k}_{k} * m{k}_{j} AS m{i}_{j}" if i != k else f"m{i}_{j}"
                for i in size
                for j in range(len(size) + 1)
            ]
            ctes.append(f"step{r}_{k + 1} AS MATERIALIZED (SELECT b, {', '.join(cells)} FROM step{r}_{k})")
        new = ", ".join(f"c{i} - m{i}_6 / m{i}_{i} AS c{i}" for i in size)
        ctes.append(f"beta{r + 1} AS MATERIALIZED (SELECT b, up, down, {new} FROM beta{r} JOIN step{r}_6 USING (b))")
    ctes.append(f"fitted AS (SELECT b, {', '.join(beta)} FROM beta{rounds})")
    return ",\n".join(ctes)


def _ordinal_scores(rows: str) -> str:
    """``ordinal_scored``: all columns of ``rows`` with v0 .. v4 and ``ordinal_pred``."""
    values = [*(f"coalesce({name}, 0e0)" for name in _INPUTS), "1e0"]
    score = " + ".join(f"f.c{i} * {v}" for i, v in enumerate(values))
    edges = ["1e0", "g0", "g1", "g2", "g3", "0e0"]
    parts = ", ".join(f"least(1e0, greatest(0e0, {a} - {b})) AS u{i}" for i, (a, b) in enumerate(zip(edges, edges[1:])))
    greater = ", ".join(f"max(1e0 / (1e0 + exp(-({score})))) FILTER (f.b = {k}) AS g{k}" for k in range(4))
    return f"""greater AS (SELECT r.id, {greater} FROM {rows} r, fitted f GROUP BY r.id),
clipped_parts AS (SELECT id, {parts} FROM greater),
summed_parts AS (SELECT *, (((u0 + u1) + u2) + u3) + u4 AS t FROM clipped_parts),
shares AS (SELECT id, {", ".join(f"u{i} / CASE WHEN t = 0 THEN 1e0 ELSE t END AS v{i}" for i in range(5))} FROM summed_parts),
ordinal_scored AS (
  SELECT r.*, v0, v1, v2, v3, v4, CAST(CASE WHEN early_gate_score IN (0, 4) THEN early_gate_score
    ELSE list_position([v0, v1, v2, v3, v4], greatest(v0, v1, v2, v3, v4)) - 1 END AS INTEGER) AS ordinal_pred
  FROM {rows} r JOIN shares USING (id)
)"""


_CELLS = " UNION ALL ".join(
    f"SELECT t1, t2, t3, t4, {y} AS t, unnest([0, 1, 2, 3, 4]) AS p, "
    f"unnest([a.c{y}, b.c{y} - a.c{y}, c.c{y} - b.c{y}, d.c{y} - c.c{y}, n{y} - d.c{y}]) AS n FROM looked"
    for y in range(5)
)
GRID_KEY = "t1 * 1000000000000000 + t2 * 10000000000 + t3 * 100000 + t4"
GRID = f"""{HISTOGRAM},
cut AS (SELECT unnest(range(0, 10001, 500)) AS bin UNION SELECT unnest([2000, 4000, 6000, 8500])),
below AS (
  SELECT cut.bin, {", ".join(f"CAST(coalesce(sum(n) FILTER (label = {y} AND h.bin < cut.bin), 0) AS BIGINT) AS c{y}" for y in range(5))}
  FROM cut, histogram h GROUP BY ALL
),
totals AS (SELECT {", ".join(f"CAST(coalesce(sum(n) FILTER (label = {y}), 0) AS BIGINT) AS n{y}" for y in range(5))} FROM histogram),
looked AS (
  SELECT a.bin AS t1, b.bin AS t2, c.bin AS t3, d.bin AS t4, a, b, c, d, totals.*
  FROM below a JOIN below b ON a.bin < b.bin JOIN below c ON b.bin < c.bin JOIN below d ON c.bin < d.bin, totals
  WHERE a.bin BETWEEN 0 AND 4000 AND b.bin BETWEEN 2000 AND 7000
    AND c.bin BETWEEN 4000 AND 9000 AND d.bin BETWEEN 6000 AND 10000
),
grid_cells AS ({_CELLS}),
{agreement(f"SELECT {GRID_KEY} AS g, t, p, n FROM grid_cells WHERE n > 0").lstrip()}"""


def _details() -> str:
    return f"""WITH {FEATURE_PAIRS}
SELECT id, heuristic_pred AS predicted_score,
  CASE WHEN early_gate_score IS NULL THEN heuristic_raw_score END AS raw_continuous_score,
  CASE WHEN early_gate_score IS NOT NULL THEN 'early_gate_override' END AS reason,
  CASE WHEN early_gate_score IS NULL THEN {r4('c1')} END AS part_nli_margin,
  CASE WHEN early_gate_score IS NULL THEN 3 ELSE 0 END AS n_parts, 15e-2 AS weight_lemma_recall
FROM scored"""


def _report() -> str:
    lines = " UNION ALL ".join(
        f"""SELECT '{k}' AS label, coalesce(sum(n) FILTER (t = {k} AND p = {k}), 0)::DOUBLE AS hit,
  coalesce(sum(n) FILTER (t = {k}), 0)::DOUBLE AS rt, coalesce(sum(n) FILTER (p = {k}), 0)::DOUBLE AS rp FROM cells"""
        for k in range(5)
    )
    return f"""WITH {PREDICTED}, cells AS ({cells_of('predicted', 'y', 'pred')}),
lines AS ({lines}),
scores AS (
  SELECT label, CASE WHEN rp > 0 THEN hit / rp ELSE 0e0 END AS pr, CASE WHEN rt > 0 THEN hit / rt ELSE 0e0 END AS rc,
    CASE WHEN rt + rp > 0 THEN 2e0 * hit / (rt + rp) ELSE 0e0 END AS f, rt, hit FROM lines
),
whole AS (
  SELECT label, pr, rc, f, rt FROM scores
  UNION ALL SELECT 'accuracy', NULL, NULL, sum(hit) / sum(rt), sum(rt) FROM scores
  UNION ALL SELECT 'macro avg', avg(pr), avg(rc), avg(f), sum(rt) FROM scores
  UNION ALL SELECT 'weighted avg', sum(pr * rt) / sum(rt), sum(rc * rt) / sum(rt), sum(f * rt) / sum(rt), sum(rt) FROM scores
)
SELECT label, {r4('pr')} AS precision, {r4('rc')} AS recall, {r4('f')} AS f1, CAST(rt AS BIGINT) AS support FROM whole"""


def _distribution(source: str, label: str) -> str:
    return f"""counts AS (SELECT {label}, count(*) AS n FROM {source} WHERE {label} IS NOT NULL GROUP BY ALL),
shares AS (SELECT *, 1e2 * n / sum(n) OVER () AS x FROM counts)
SELECT {label}, n, {r4('x')} AS percent FROM shares"""


def _profile_text(x: str) -> str:
    return strip(f"translate(lower(coalesce({x}, '')), '{PUNCTUATION}', '')")


TWO_RATERS = f"""{FEATURE_PAIRS},
two AS (
  SELECT *, coalesce(early_gate_score, {rubric('heuristic_raw_score', ('15e-2', '3e-1', '5e-1', '8e-1'))}) AS ordinal_pred
  FROM scored
),
long AS (
  SELECT 'heuristic' AS approach, human_score AS y, heuristic_pred AS pred FROM two
  UNION ALL SELECT 'ordinal_ml', human_score, ordinal_pred FROM two
),{agreement(cells_of('long', 'y', 'pred', 'approach'), 'approach')}"""

PAIR_COLUMNS = "participant_id, sheet_name, row_ordinal, stimulus, transcription, human_score"


def oracle_sql() -> dict[str, str]:
    """SQL per registered query; the random forest has none."""
    sql: dict[str, str] = {}
    sql["sheet_names"] = f"""WITH {SHEET_ROWS}
SELECT DISTINCT sheet_name, regexp_matches(lower(trim(sheet_name)), '{IGNORED}') AS ignored,
  {participant('sheet_name')} AS participant_id FROM all_rows"""
    sql["load_standardize"] = f"""WITH {SHEET_ROWS},{flagged()}
SELECT {PAIR_COLUMNS} FROM flagged WHERE reason IS NULL"""
    sql["load_dedup_first"] = f"""WITH {SHEET_ROWS},
twice AS (
  SELECT * FROM sheet_rows UNION ALL
  SELECT sheet_ordinal, sheet_name, row_ordinal + 1000000, stimulus, transcription, '2' FROM sheet_rows
),{flagged('twice')}
SELECT {PAIR_COLUMNS} FROM pairs"""
    sql["sheets_of_several_headers"] = sql["load_standardize"]
    third = r"CAST(regexp_extract(sheet_name, '\d+') AS BIGINT) % 3"
    sql["sheet_cache_refresh"] = f"""WITH {SHEET_ROWS},
left_over AS (
  SELECT * REPLACE (CASE WHEN {third} = 1 THEN '2' ELSE human_score END AS human_score) FROM sheet_rows WHERE {third} < 2
),{flagged('left_over')}
SELECT {PAIR_COLUMNS} FROM pairs WHERE human_score IS NOT NULL"""
    sql["saved_table_by_sheet"] = f"""WITH {SHEET_ROWS},{flagged()}
SELECT CAST(length(sheet_name) % 7 AS INTEGER) AS part, count(*) AS n, count(human_score) AS scored,
  count(DISTINCT sheet_name) AS sheets FROM flagged WHERE reason IS NULL GROUP BY ALL"""
    sql["load_holdout"] = f"""WITH {SHEET_ROWS},
unscored AS (SELECT * REPLACE (CAST(NULL AS VARCHAR) AS human_score) FROM sheet_rows),{flagged('unscored', 'holdout')}
SELECT {PAIR_COLUMNS} FROM pairs"""
    report = f"""{SHEET_ROWS},{flagged()},
copies AS (SELECT sheet_name, row_ordinal, copy, human_score FROM ranked),
report AS (
  SELECT sheet_name, count(*) AS rows_read, count(*) FILTER (reason = 'missing') AS dropped_missing,
    count(*) FILTER (reason = 'blank') AS dropped_blank,
    count(*) FILTER ((reason IS NULL OR reason = 'out_of_range') AND human_score IS NULL) AS invalid_scores,
    count(*) FILTER (reason = 'out_of_range') AS out_of_range, count(*) FILTER (reason IS NULL) AS kept,
    count(*) FILTER (copy > 1) AS deduplicated,
    count(*) FILTER (copy = 1 AND human_score IS NULL) AS missing_scores,
    count(*) FILTER (copy = 1 AND human_score IS NOT NULL) AS final_rows
  FROM (SELECT f.*, c.copy FROM flagged f LEFT JOIN copies c USING (sheet_name, row_ordinal)) GROUP BY ALL
)"""
    sql["load_report"] = f"WITH {report} SELECT * FROM report"
    # Without labels nothing is out of range and no score is missing for the holdout.
    holdout = f"""{flagged(role='holdout')},
copies AS (SELECT sheet_name, row_ordinal, copy, human_score FROM ranked)
SELECT 'holdout' AS role, sheet_name, count(*) AS rows_read, count(*) FILTER (reason = 'missing') AS dropped_missing,
  count(*) FILTER (reason = 'blank') AS dropped_blank,
  count(*) FILTER (reason IS NULL AND human_score IS NULL) AS invalid_scores, 0 AS out_of_range,
  count(*) FILTER (reason IS NULL) AS kept, count(*) FILTER (copy > 1) AS deduplicated, 0 AS missing_scores,
  count(*) FILTER (copy = 1) AS final_rows
FROM (SELECT f.*, c.copy FROM flagged f LEFT JOIN copies c USING (sheet_name, row_ordinal)) GROUP BY ALL"""
    sql["load_reports_of_run"] = f"""WITH {report}, other AS (WITH {SHEET_ROWS},{holdout})
SELECT 'tuning' AS role, * FROM report UNION ALL SELECT * FROM other"""
    sql["load_summary"] = f"""WITH {report}
SELECT (SELECT count(DISTINCT sheet_name) FROM all_rows) AS sheets_total,
  (SELECT count(DISTINCT sheet_name) FROM all_rows) - count(*) FILTER (kept > 0) AS sheets_skipped,
  count(*) FILTER (kept > 0) AS sheets_valid, CAST(sum(kept) AS BIGINT) AS kept,
  CAST(sum(deduplicated) AS BIGINT) AS deduplicated, CAST(sum(missing_scores) AS BIGINT) AS missing_scores,
  CAST(sum(final_rows) AS BIGINT) AS final_rows FROM report"""
    sql["label_parse"] = f"""WITH {SHEET_ROWS},
parsed AS (SELECT {number('human_score')} AS number, {label('human_score')} AS label FROM sheet_rows)
SELECT number, label, count(*) AS n, bool_and(number % 1 = 0) AS integral
FROM parsed GROUP BY ALL"""
    sql["row_numbering"] = f"""WITH {SHEET_ROWS},{flagged()}
SELECT row_number() OVER (ORDER BY sheet_name, row_ordinal) - 1 AS row_index, sheet_name, row_ordinal FROM pairs"""
    sql["sample_head"] = f"""WITH {SHEET_ROWS},{flagged()}
SELECT {PAIR_COLUMNS} FROM pairs ORDER BY sheet_name, row_ordinal LIMIT 10"""

    for name, table, key, text, options in (
        ("clean_documents", "documents", "doc_id", "text", {}),
        ("clean_pages", "pages", "page_id", "html", {}),
        ("clean_keep_accents", "documents", "doc_id", "text", {"lower": False, "accents_off": False}),
    ):
        sql[name] = f"""SELECT {key}, md5(x) AS digest, CAST(length(x) AS INTEGER) AS n_clean
FROM (SELECT {key}, {clean(text, **options)} AS x FROM {table})"""
    sql["clean_noisy_pairs"] = f"""WITH {CLEANED}
SELECT sheet_name, row_ordinal, clean_stimulus, clean_response FROM cleaned"""
    folded = {c: f"trim({replace_all(c, f'[{SPACE}]+', ' ')})" for c in ("stim", "resp")}
    sql["early_gate_rows"] = f"""WITH {SHEET_ROWS},
raw AS (SELECT sheet_name, row_ordinal, {suffix_off('stimulus')} AS stim, coalesce(transcription, '') AS resp FROM sheet_rows)
SELECT sheet_name, row_ordinal, CASE WHEN NOT regexp_matches(resp, '[\\p{{L}}\\p{{N}}]') THEN 0
  WHEN {folded['stim']} <> '' AND {folded['stim']} = {folded['resp']} THEN 4 ELSE -1 END AS gate FROM raw"""
    sql["gate_summary"] = f"""WITH {CLEANED}
SELECT count(*) AS n_rows, count(human_score) AS labelled, count(*) FILTER (early_gate_score = 0) AS score_0,
  count(*) FILTER (early_gate_score = 4) AS score_4, count(*) FILTER (early_gate_score IS NULL) AS needs_features
FROM cleaned"""
    sql["eda_exact_match"] = f"""WITH {SHEET_ROWS},
counted AS (
  SELECT count(*) AS total, count(*) FILTER ({_profile_text('stimulus')} = {_profile_text('transcription')}) AS exact
  FROM sheet_rows
), shares AS (SELECT *, 1e2 * exact / total AS x FROM counted)
SELECT total, exact, total - exact AS needs_features, {r4('x')} AS exact_percent FROM shares"""
    sql["label_distribution"] = f"WITH {RATED}, {_distribution('rated', 'y')}"
    sql["quality_distribution"] = f"WITH {_distribution('labels', 'quality')}"

    row = "sheet_name, row_ordinal"
    sql["lemma_overlap"] = f"WITH {CLEANED},{overlap('cleaned', row, True)} SELECT {row}, {LEXICAL} FROM features"
    sql["word_overlap"] = f"WITH {CLEANED},{overlap('cleaned', row, False)} SELECT {row}, {LEXICAL} FROM features"
    sql["conv_overlap"] = f"""WITH turns AS (
  SELECT a.conv_id, a.turn, {clean('a.text')} AS clean_stimulus, {clean('b.text')} AS clean_response
  FROM conversations a LEFT JOIN conversations b
    ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND b.role = 'assistant'
  WHERE a.role <> 'assistant'
),{overlap('turns', 'conv_id, turn', False)} SELECT conv_id, turn, {LEXICAL} FROM features"""
    sql["vector_cosine"] = f"""WITH pairs AS (
  SELECT a.vec_id, CAST(a.embedding AS DOUBLE[]) AS a, CAST(b.embedding AS DOUBLE[]) AS b
  FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1
), dots AS (
  SELECT vec_id, least(1e0, greatest(0e0, list_dot_product(a, b)
    / sqrt(list_dot_product(a, a) * list_dot_product(b, b)))) AS x FROM pairs
) SELECT vec_id, {r4('x')} AS sbert_similarity FROM dots"""

    def total(parts: int, part: int) -> str:
        own = f"[CAST(embedding[i + 1] AS DOUBLE) for i in range(len(embedding)) if i % {parts} = {part}]"
        return f"list_reduce({own}, lambda x, y: x + y)"

    outputs = f"""outputs AS (
  SELECT vec_id, [{", ".join(f"{total(3, k)} * 2e0" for k in range(3))}] AS logits,
    {", ".join(f"({total(4, k)} + 1e0) / 2e0 AS g{k}" for k in range(4))},
    {total(1, 0)} AS score FROM embeddings
)"""
    sql["pair_margin"] = f"""WITH {outputs},
shifted AS (SELECT vec_id, [exp(x - list_max(logits)) for x in logits] AS e FROM outputs),
probs AS (
  SELECT vec_id, e[1] / t AS pe, e[2] / t AS pn, e[3] / t AS pc
  FROM (SELECT *, e[1] + e[2] + e[3] AS t FROM shifted)
), margins AS (SELECT *, pe - pc AS m FROM probs)
SELECT vec_id, {r4('pe')} AS nli_entailment, {r4('pn')} AS nli_neutral, {r4('pc')} AS nli_contradiction,
  {r4('m')} AS nli_margin FROM margins"""
    sql["joint_pair_similarity"] = f"""WITH {outputs},
clamped AS (SELECT vec_id, least(1e0, greatest(0e0, score)) AS x FROM outputs)
SELECT vec_id, {r4('x')} AS cross_encoder_similarity FROM clamped"""
    margins = f"""
leaned AS (SELECT *, 4e0 * (len(list_intersect(s, r))::DOUBLE / len(s)) - 2e0 AS lean FROM (
  SELECT clean_stimulus, clean_response, list_distinct(string_split(clean_stimulus, ' ')) AS s,
    list_distinct(string_split(clean_response, ' ')) AS r FROM open_pairs)),
powers AS (
  SELECT *, exp(lean - greatest(lean, 0e0, -lean)) AS a, exp(0e0 - greatest(lean, 0e0, -lean)) AS b,
    exp(-lean - greatest(lean, 0e0, -lean)) AS c FROM leaned
),
probs AS (SELECT *, a / ((a + b) + c) AS pe, b / ((a + b) + c) AS pn, c / ((a + b) + c) AS pc FROM powers),
margins AS (
  SELECT clean_stimulus, clean_response, {r4('pe')} AS nli_entailment, {r4('pn')} AS nli_neutral,
    {r4('pc')} AS nli_contradiction, {r4('m')} AS nli_margin FROM (SELECT *, pe - pc AS m FROM probs)
)"""
    open_pairs = "open_pairs AS (SELECT DISTINCT clean_stimulus, clean_response FROM cleaned WHERE early_gate_score IS NULL"
    sql["shared_word_margin"] = f"WITH {CLEANED},\n{open_pairs} AND clean_stimulus <> ''),{margins} SELECT * FROM margins"
    sql["hash_embed_cosine"] = f"WITH {CLEANED},\n{open_pairs}),{hashed_cosine('open_pairs')} SELECT * FROM similar_pairs"
    from_models = ("sbert_similarity", "nli_entailment", "nli_neutral", "nli_contradiction", "nli_margin")
    modelled = ", ".join(f"CASE WHEN early_gate_score IS NULL THEN coalesce({c}, 0e0) END AS {c}" for c in from_models)
    lexical = ", ".join(
        f"CASE WHEN early_gate_score IS NULL THEN {c.strip()} END AS {c.strip()}" for c in LEXICAL.split(",")
    )
    sql["model_features"] = f"""WITH {CLEANED},{overlap('cleaned', row, False)},
{open_pairs} AND clean_stimulus <> ''),{hashed_cosine('open_pairs')},{margins}
SELECT {", ".join(f"f.{k.strip()}" for k in row.split(","))}, early_gate_score, {lexical}, {modelled}
FROM features f LEFT JOIN similar_pairs s ON s.clean_stimulus = f.clean_stimulus AND s.clean_response = f.clean_response
  LEFT JOIN margins m ON m.clean_stimulus = f.clean_stimulus AND m.clean_response = f.clean_response"""
    gated_columns = ", ".join(
        f"CASE WHEN early_gate_score IS NULL THEN {c.strip()} END AS {c.strip()}" for c in LEXICAL.split(",")
    )
    sql["gated_features"] = f"""WITH {CLEANED},{overlap('cleaned', row, False)}
SELECT {row}, human_score, early_gate_score, {gated_columns} FROM features"""

    sql["contributions"] = f"""WITH {FEATURE_PAIRS}
SELECT id, {r4('c1')} AS part_nli_margin, {r4('c2')} AS part_sbert_similarity, {r4('c3')} AS part_lemma_recall FROM weighted"""
    sql["raw_score"] = f"WITH {FEATURE_PAIRS} SELECT id, heuristic_raw_score FROM scored"
    sql["rubric"] = f"WITH {FEATURE_PAIRS} SELECT id, heuristic_raw_score, heuristic_pred FROM scored"
    sql["score_details"] = _details()

    sql["confusion"] = f"""WITH {PREDICTED}
SELECT CAST(l.k AS INTEGER) AS truth, {", ".join(f"count(*) FILTER (pred = {k}) AS pred_{k}" for k in range(5))}
FROM (SELECT unnest(range(5)) AS k) l LEFT JOIN predicted ON y = l.k GROUP BY ALL"""
    sql["agreement"] = f"""WITH {PREDICTED},{agreement(cells_of('predicted', 'y', 'pred'))}
SELECT n, qwk, accuracy, macro_f1 FROM rounded"""
    sql["agreement_by_group"] = f"""WITH {PREDICTED},{agreement(cells_of('predicted', 'y', 'pred', 'status'), 'status')}
SELECT status, n, qwk, accuracy, macro_f1 FROM rounded"""
    sql["qwk_absent_label"] = f"""WITH {PREDICTED}, kept AS (SELECT * FROM predicted WHERE y <> 2 AND pred <> 2),
{agreement(cells_of('kept', 'y', 'pred')).lstrip()}
SELECT n, qwk, accuracy, macro_f1 FROM rounded"""
    sql["class_report"] = _report()
    sql["off_by_k"] = f"""WITH {PREDICTED}
SELECT CAST(abs(y - pred) AS INTEGER) AS off_by, count(*) AS n FROM predicted GROUP BY ALL"""

    sql["stratified_split"] = f"WITH {quotas(True)}"
    sql["plain_split"] = f"WITH {quotas(False)}"
    second = ("15e-2", "3e-1", "5e-1", "8e-1")
    sql["threshold_predict"] = f"WITH {RATED} SELECT id, raw, {rubric('raw', second)} AS pred FROM rated"
    sql["threshold_evaluate"] = f"""WITH {RATED}, cut AS (SELECT y, {rubric('raw', second)} AS pred FROM rated),
{agreement(cells_of('cut', 'y', 'pred')).lstrip()}
SELECT n, qwk, accuracy, macro_f1 FROM rounded"""
    sql["threshold_histogram"] = f"WITH {HISTOGRAM} SELECT bin, label, n FROM histogram"
    sql["threshold_refined"] = f"""{_shortest_paths(8)}
SELECT {", ".join(f"t{k} / 1e4 AS t{k}" for k in range(1, 5))}, {r4("k")} AS qwk
FROM (SELECT *, 1e0 - (SELECT max(n) FROM sums) * mu AS k FROM round8)"""
    sql["threshold_compare"] = f"""{_shortest_paths(8)},
cut AS (
  SELECT 'initial' AS stage, y, {rubric('raw')} AS pred FROM rated
  UNION ALL
  SELECT 'optimized', y, {rubric('raw', ('t1 / 1e4', 't2 / 1e4', 't3 / 1e4', 't4 / 1e4'))} FROM rated, round8
),
{agreement("SELECT stage AS g, y AS t, pred AS p, count(*) AS n FROM cut GROUP BY ALL").lstrip()}
SELECT g AS stage, n, qwk, accuracy, macro_f1 FROM rounded"""
    sql["threshold_grid_best"] = f"""WITH {GRID},
best AS (
  SELECT m.k, g.t1, g.t2, g.t3, g.t4 FROM metrics m
  JOIN (SELECT DISTINCT t1, t2, t3, t4, {GRID_KEY} AS g FROM grid_cells) g ON g.g = m.g
  WHERE m.k IS NOT NULL ORDER BY round(m.k, 12) DESC, t1, t2, t3, t4 LIMIT 1
)
SELECT t1 / 1e4 AS t1, t2 / 1e4 AS t2, t3 / 1e4 AS t3, t4 / 1e4 AS t4, {r4('k')} AS qwk FROM best"""

    split_sides = f"{FEATURE_PAIRS},\nsides_of AS (WITH {quotas(True)})"
    chosen = "SELECT p.* FROM feature_pairs p JOIN sides_of s USING (id) WHERE s.split = "
    sql["ordinal_logistic"] = f"""WITH {split_sides},
{_newton(chosen + "'train'", 10)},
held AS ({chosen}'validation'),
{_ordinal_scores('held')}
SELECT id, ordinal_pred, {", ".join(f"{r4(f'v{k}')} AS prob_{k}" for k in range(5))} FROM ordinal_scored"""
    listed = ", ".join(f"c{i}" for i in range(6))
    named = ", ".join(f"'{name}'" for name in (*_INPUTS, "intercept"))
    sql["ordinal_summary"] = f"""WITH {FEATURE_PAIRS},
{_newton("SELECT * FROM feature_pairs", 10)},
listed AS (SELECT b, unnest([{named}]) AS feature, unnest([{listed}]) AS v FROM fitted)
SELECT 'logistic_regression' AS model_type, 'y > ' || b AS binary_task, feature, {r4('v')} AS value FROM listed"""
    open_histogram = f"""{FEATURE_PAIRS},
histogram AS (SELECT CAST(round(heuristic_raw_score * 10000) AS INTEGER) AS bin, human_score AS label, count(*) AS n
  FROM raw_scored WHERE early_gate_score IS NULL GROUP BY ALL)"""
    cuts = tuple(f"t{k} / 1e4" for k in range(1, 5))
    sql["holdout_score"] = f"""{_shortest_paths(8, open_histogram)},
{_newton("SELECT * FROM feature_pairs", 10)},
{_ordinal_scores('raw_scored')}
SELECT id, early_gate_score, heuristic_raw_score, ordinal_pred,
  CAST(CASE WHEN early_gate_score IN (0, 4) THEN early_gate_score ELSE {rubric('heuristic_raw_score', cuts)} END AS INTEGER)
    AS heuristic_pred FROM ordinal_scored, round8"""

    edges = ["1e0", "g0", "g1", "g2", "g3", "0e0"]
    parts = ", ".join(
        f"least(1e0, greatest(0e0, {a} - {b})) AS u{i}" for i, (a, b) in enumerate(zip(edges, edges[1:]))
    )
    sql["ordinal_proba_recover"] = f"""WITH {outputs},
clipped AS (SELECT vec_id, {parts} FROM outputs),
summed AS (SELECT *, (((u0 + u1) + u2) + u3) + u4 AS t FROM clipped),
probs AS (SELECT vec_id, {", ".join(f"u{i} / CASE WHEN t = 0 THEN 1e0 ELSE t END AS v{i}" for i in range(5))} FROM summed)
SELECT vec_id, {", ".join(f"{r4(f'v{i}')} AS prob_{i}" for i in range(5))},
  CAST(list_position([v0, v1, v2, v3, v4], greatest(v0, v1, v2, v3, v4)) - 1 AS INTEGER) AS ordinal_pred FROM probs"""

    sql["ab_summary"] = f"""WITH {TWO_RATERS}
SELECT 'validation_from_tuning' AS evaluation_split, approach, qwk, accuracy, macro_f1 FROM rounded"""
    sql["ab_winner"] = f"""WITH {TWO_RATERS},
wide AS (SELECT max(qwk) FILTER (approach = 'heuristic') AS h, max(qwk) FILTER (approach = 'ordinal_ml') AS o FROM rounded)
SELECT CASE WHEN h >= o THEN 'heuristic' ELSE 'ordinal_ml' END AS winner, greatest(h, o) AS qwk,
  CASE WHEN greatest(h, o) >= 8e-1 THEN 'expert' ELSE 'below_expert' END AS agreement FROM wide"""
    sql["validation_table"] = f"""WITH {TWO_RATERS}
SELECT id AS original_row_index, human_score, early_gate_score, heuristic_pred, ordinal_pred, heuristic_raw_score FROM two"""
    sql["tuning_audit"] = f"""WITH {SHEET_ROWS},{flagged()},{gated('pairs')},{overlap('cleaned', row, False)}
SELECT row_number() OVER (ORDER BY sheet_name, row_ordinal) - 1 AS row_index, participant_id, sheet_name, stimulus,
  transcription, clean_stimulus, clean_response, CAST(trunc(human_score) AS INTEGER) AS human_score, early_gate_score,
  {gated_columns} FROM features"""
    rated_rows = "rated AS (SELECT id, human_score AS y FROM feature_pairs)"
    unused = "unused AS (SELECT 1 AS one)"
    cut_columns = "t1, t2, t3, t4, 1e0 - (SELECT max(n) FROM sums) * mu AS k"
    scored_rows = FEATURE_PAIRS[FEATURE_PAIRS.index("weighted AS (") :]
    sql["experiment_summary"] = f"""WITH feature_pairs AS MATERIALIZED (
WITH {SHEET_ROWS},{flagged()},{gated('pairs')},{overlap('cleaned', row, False)},
{open_pairs} AND clean_stimulus <> ''),{hashed_cosine('open_pairs')},{margins}
SELECT row_number() OVER (ORDER BY f.sheet_name, f.row_ordinal) - 1 AS id, CAST(trunc(human_score) AS INTEGER) AS human_score,
  early_gate_score, CASE WHEN early_gate_score IS NULL THEN lemma_recall END AS lemma_recall, {modelled}
FROM features f LEFT JOIN similar_pairs s ON s.clean_stimulus = f.clean_stimulus AND s.clean_response = f.clean_response
  LEFT JOIN margins m ON m.clean_stimulus = f.clean_stimulus AND m.clean_response = f.clean_response),
{scored_rows},
sides_of AS MATERIALIZED (WITH {quotas(True, rated_rows)}),
train_side AS MATERIALIZED (SELECT p.* FROM raw_scored p JOIN sides_of s USING (id) WHERE s.split = 'train'),
held AS MATERIALIZED (SELECT p.* FROM raw_scored p JOIN sides_of s USING (id) WHERE s.split = 'validation'),
histogram AS MATERIALIZED (SELECT CAST(round(heuristic_raw_score * 10000) AS INTEGER) AS bin, human_score AS label, count(*) AS n
  FROM train_side WHERE early_gate_score IS NULL GROUP BY ALL),
with_zero AS ({_shortest_paths(8, unused, range(5), "(n0 > 0 OR (SELECT count(*) FROM histogram WHERE label = 0) > 0)")}
  SELECT {cut_columns} FROM round8),
without_zero AS ({_shortest_paths(8, unused, range(1, 5), "n0 = 0 AND (SELECT count(*) FROM histogram WHERE label = 0) = 0")}
  SELECT {cut_columns} FROM round8),
best_cuts AS (
  SELECT * FROM (SELECT * FROM with_zero UNION ALL SELECT * FROM without_zero) WHERE k IS NOT NULL
  ORDER BY k DESC, t1, t2, t3, t4 LIMIT 1
),
{_newton("SELECT * FROM train_side", 10)},
{_ordinal_scores('held')},
both_graded AS (
  SELECT *, coalesce(early_gate_score, {rubric('heuristic_raw_score', tuple(f"t{k} / 1e4" for k in range(1, 5)))}) AS heuristic_pred
  FROM ordinal_scored, best_cuts
),
long AS (
  SELECT 'heuristic' AS approach, human_score AS y, heuristic_pred AS pred FROM both_graded
  UNION ALL SELECT 'ordinal_ml', human_score, ordinal_pred FROM both_graded
),{agreement(cells_of('long', 'y', 'pred', 'approach'), 'approach')}
SELECT 'validation_from_tuning' AS evaluation_split, approach, qwk, accuracy, macro_f1 FROM rounded"""
    sql["sanity_check"] = f"SELECT * FROM ({sql['tuning_audit']}) ORDER BY row_index LIMIT 3"
    sql["report_export"] = f"""WITH {SHEET_ROWS},{flagged()},{gated('pairs')},{overlap('cleaned', row, False)},
graded AS (SELECT *, CASE WHEN early_gate_score IS NULL THEN lemma_recall ELSE 0e0 END AS raw FROM features)
SELECT participant_id AS "ID", stimulus AS "Target Sentence", transcription AS "Student Response",
  coalesce(early_gate_score, {rubric('raw')}) AS "AI Final Grade (0-4)", early_gate_score AS "Early Gate Hit",
  raw AS "Confidence Score (0-1)" FROM graded"""
    sql["overlap_agreement"] = f"""WITH {CLEANED},{overlap('cleaned', row, False)},
graded AS (SELECT human_score, coalesce(early_gate_score, {rubric('lemma_recall')}) AS pred FROM features),
{agreement(cells_of('graded', 'human_score', 'pred')).lstrip()}
SELECT n, qwk, accuracy, macro_f1 FROM rounded"""
    return sql
