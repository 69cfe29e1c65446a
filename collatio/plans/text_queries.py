"""Queries over texts, identifiers, vectors and markup with their DuckDB SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from collatio import report
from collatio.functions import guards as G
from collatio.functions import ids, lexicon
from collatio.functions import similarity as S
from collatio.functions import text as T
from collatio.operators import attribution as A
from collatio.operators import judging as J
from collatio.operators import metrics as X
from collatio.plans import adapters as D
from collatio.session import scratch
from collatio.sources import folio, marked, tables, tei

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _golden(pairs: list[tuple[str, str]]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in pairs) + ") t(input, value)"


# ---- segments


@query(f"WITH {D.LINES} SELECT doc_id, seq, witness, chapter, md5(text) AS digest FROM lines")
def segments_scan(spark: SparkSession, d: str) -> DataFrame:
    return D.lines(spark, d).select("doc_id", "seq", "witness", "chapter", F.md5("text").alias("digest"))


WORDS = "len(list_filter(string_split_regex({}, '\\s+'), lambda x: x <> ''))"


@query(
    f"""WITH {D.LINES}, k AS (SELECT *, text || CASE WHEN seq % 10 = 3 THEN ' རྫོགས་སོ' ELSE '' END AS t
  FROM lines) SELECT chapter, CASE WHEN seq % 10 = 3 THEN 'colophon'
  WHEN {WORDS.format('t')} IN (7, 9, 11) THEN 'verse_line' ELSE 'prose' END AS kind, count(*) AS n, sum(len(t))::BIGINT AS chars FROM k GROUP BY ALL"""
)
def segment_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of lines; every tenth line is given a colophon's end."""
    rows = D.lines(spark, d).withColumn("text", F.concat("text", F.when(F.col("seq") % 10 == 3, " རྫོགས་སོ").otherwise("")))
    return rows.groupBy("chapter", folio.classify(F.col("text")).alias("kind")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


LATIN, CJK = ".,;:?!", "。，；：？！"
CLAUSES = f"(SELECT doc_id, unnest(regexp_extract_all(translate(text, '{LATIN}', '{CJK}'), '([^{T.CLAUSE_MARKS}]*[{T.CLAUSE_MARKS}]|[^{T.CLAUSE_MARKS}]+$)')) AS c FROM documents)"


@query(
    f"""SELECT doc_id, count(*) AS n_clauses, sum(len(regexp_replace(c, '^\\s+|\\s+$', '', 'g')))::BIGINT AS chars
  FROM {CLAUSES} WHERE len(regexp_replace(c, '{T.STRIPPED}', '', 'g')) > 0 GROUP BY doc_id"""
)
def clause_split(spark: SparkSession, d: str) -> DataFrame:
    """Clauses of documents whose marks are read as Chinese ones."""
    parts = T.clauses(F.translate("text", LATIN, CJK))
    c = D.table(spark, d, "documents").select("doc_id", F.explode(parts).alias("c"))
    return c.groupBy("doc_id").agg(F.count("*").alias("n_clauses"), F.sum(F.length("c")).alias("chars"))


def _tei(spark: SparkSession, d: str) -> DataFrame:
    """Documents as TEI: the source as head, the text with Chinese marks as one paragraph with a note."""
    text = report.xml_text(F.translate("text", LATIN, CJK))
    xml = F.concat(
        F.lit('<TEI><text><body><lb n="'), F.col("doc_id").cast("string"), F.lit('"/><head>'), report.xml_text(F.col("source")),
        F.lit("</head><p>"), text, F.lit("<note>n</note></p></body></text></TEI>"),
    )
    return D.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("witness"), xml.cast("binary").alias("content"))


ONLY = "[" + "".join(sorted(set(tei.ONLY_MARKS))) + "]"
TEI_CLAUSES = f"""(SELECT doc_id, unnest(regexp_extract_all(regexp_replace(translate(text, '{LATIN}', '{CJK}'), '[\n\r\t]', '', 'g'),
  '([^{T.CLAUSE_MARKS}]*[{T.CLAUSE_MARKS}]+[」』]?|[^{T.CLAUSE_MARKS}]+$)')) AS c FROM documents)"""


@query(f"""SELECT doc_id::VARCHAR AS witness, 'prose' AS kind, count(*) AS n, sum(len(trim(c)))::BIGINT AS chars, doc_id::VARCHAR AS start,
  1::BIGINT AS notes FROM {TEI_CLAUSES} WHERE len(regexp_replace(c, '{ONLY}', '', 'g')) > 0 GROUP BY doc_id
UNION ALL SELECT doc_id::VARCHAR, 'head', 1, len(trim(source)), doc_id::VARCHAR, 0 FROM documents WHERE source IS NOT NULL AND text IS NOT NULL""")
def tei_segments(spark: SparkSession, d: str) -> DataFrame:
    got = tei.parsed(_tei(spark, d).where("content is not null"), 0, tei.SEGMENTS)
    return got.groupBy("witness", "kind").agg(
        F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.first("start").alias("start"),
        F.max("inline_notes").cast("long").alias("notes"),
    )


def _back(spark: SparkSession, d: str) -> DataFrame:
    """Regions as documents with an apparatus of their nations and a gloss."""
    nations = F.array_join(
        F.transform(F.array_sort(F.collect_list("n_name")), lambda n: F.concat(F.lit('<rdg wit="#'), n, F.lit('">'), n, F.lit("</rdg>"))),
        "",
    )
    per = D.table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(nations.alias("rdg"))
    r = D.table(spark, d, "region").join(per, "r_regionkey")
    xml = F.concat(
        F.lit('<TEI><text><body/><back><app from="#'), F.col("r_regionkey").cast("string"), F.lit('"><lem>'), F.col("r_name"), F.lit("</lem>"), F.col("rdg"),
        F.lit('</app><tt from="#g"><t xml:lang="zh-Hant">字</t><t xml:lang="sa">'), F.col("r_name"), F.lit(".</t></tt></back></text></TEI>"),
    )
    return r.select(F.col("r_name").alias("witness"), xml.cast("binary").alias("content"))


@query(
    """SELECT r_name AS witness, '#' || r_regionkey AS anchor, r_name AS lem, string_agg(n_name, ' ' ORDER BY n_name) AS rdg,
  string_agg('#' || n_name, ' ' ORDER BY n_name) AS wit FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL"""
)
def tei_apparatus(spark: SparkSession, d: str) -> DataFrame:
    got = tei.parsed(_back(spark, d), 2, tei.APPARATUS)
    return got.select("witness", "anchor", "lem", F.array_join("rdg", " ").alias("rdg"), F.array_join("wit", " ").alias("wit"))


@query("SELECT DISTINCT r_name AS witness, '字' AS zh, r_name AS sa, '#g' AS anchor FROM region JOIN nation ON n_regionkey = r_regionkey")
def tei_glosses(spark: SparkSession, d: str) -> DataFrame:
    return tei.parsed(_back(spark, d), 1, tei.GLOSSES)


@query(f"""WITH t AS (SELECT doc_id, translate(replace(text, chr(10), ''),
  '.{{', '།(') AS t FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, regexp_extract_all(t, '([^།]*།|[^།]+$)') AS us FROM t),
u AS (SELECT doc_id, i - 1 AS seq, regexp_replace(us[i], '^\\s+|\\s+$', '', 'g') AS text FROM (SELECT doc_id, us, unnest(range(1, len(us) + 1)) AS i FROM p))
SELECT 'D' || doc_id AS text_id, count(*) AS n, max(seq)::BIGINT AS last, sum(len(text))::BIGINT AS chars,
  count(*) FILTER (len(list_filter(string_split_regex(text, '[\\s།]+'), lambda x: x <> '')) IN (7, 9, 11)) AS verses
  FROM u WHERE text NOT IN ('', '།') GROUP BY doc_id""")
def folio_units(spark: SparkSession, d: str) -> DataFrame:
    """Documents as texts of one folio file each, cut at their full stops; lines after the first are at its coordinate."""
    body = F.translate("text", ".{", "།(")
    rows = D.table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split(body, "\n")).alias("line_no", "line"))
    mark = F.when(F.col("line_no") == 0, F.concat(F.lit("[1a.1]{D"), F.col("doc_id").cast("string"), F.lit("}"))).otherwise("")
    units = folio.parse_folio(rows.select(F.col("doc_id").cast("string").alias("file"), "line_no", F.concat(mark, "line").alias("line")))
    return units.groupBy("text_id").agg(
        F.count("*").alias("n"), F.max("seq").cast("long").alias("last"), F.sum(F.length("text")).alias("chars"),
        F.count_if(F.col("kind") == "verse_line").alias("verses"),
    )


@query(f"""WITH m AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS p, l
  FROM (SELECT doc_id, string_split(translate(text, '{LATIN}', '{CJK}'), chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
c AS (SELECT doc_id, 1 + (p - 1) // 3 AS chapter, p, unnest(regexp_extract_all(l[p],
  '([^{T.CLAUSE_MARKS}]*[{T.CLAUSE_MARKS}]|[^{T.CLAUSE_MARKS}]+$)')) AS c FROM m)
SELECT witness, 'L.' || ch AS chapter, n, chars, 'c' || ch || ':' || n AS last, (ch - 1)::INT AS "order"
  FROM (SELECT doc_id::VARCHAR AS witness, chapter AS ch, count(*) AS n, sum(len(regexp_replace(c, '^\\s+|\\s+$', '',
  'g')))::BIGINT AS chars FROM c WHERE len(regexp_replace(c, '{T.STRIPPED}', '', 'g')) > 0 AND chapter <= 99 GROUP BY doc_id, chapter)""")
def marked_clauses(spark: SparkSession, d: str) -> DataFrame:
    """Documents as marked texts with a chapter for every three lines, up to 99."""
    rows = D.table(spark, d, "documents").where("text is not null").select(
        "doc_id", F.posexplode(F.split(F.translate("text", LATIN, CJK), "\n")).alias("p", "line"),
    ).where("p < 297")
    clean = F.regexp_replace("line", r"(?U)^\s+|\s+$", "")
    head = rows.where("p % 3 = 0").select(
        "doc_id", (F.col("p") * 2).alias("line_no"), F.concat(F.lit("#"), F.floor(F.col("p") / 3 + 1).cast("string")).alias("line"),
    )
    lines = head.union(
        rows.where(~clean.startswith("#") & ~clean.startswith("//")).select("doc_id", (F.col("p") * 2 + 1).alias("line_no"), "line")
    ).withColumn("file", F.col("doc_id").cast("string"))
    got = marked.parse_marked(lines)
    return got.groupBy("witness", "chapter").agg(
        F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.max_by("end", "seq").alias("last"),
        F.max("order").cast("int").alias("order"),
    )


@query(
    """SELECT 'customers' AS witness, 'I.' || (1 + c_nationkey % 11) || '.' || (1 + c_custkey % 900) AS unit,
  'I.' || (1 + c_nationkey % 11) AS chapter, 'verse' AS kind, trim(regexp_replace(lower(c_name), '[#0-9]+', ' ', 'g')) AS text,
  CASE WHEN c_acctbal < 0 THEN 'LACUNA' END AS flag FROM customer"""
)
def reference_rows(spark: SparkSession, d: str) -> DataFrame:
    """Customers as lines of a reference edition, between comments."""
    c = D.table(spark, d, "customer")
    unit = F.concat(F.lit("I."), (1 + F.col("c_nationkey") % 11).cast("string"), F.lit("."), (1 + F.col("c_custkey") % 900).cast("string"))
    line = F.concat_ws("\t", unit, F.regexp_replace("c_name", "#", " "), F.when(F.col("c_acctbal") < 0, "lacuna"))
    lines = c.select(
        F.lit("customers").alias("file"), F.col("c_custkey").alias("line_no"), line.alias("line"),
    ).union(c.select(F.lit("customers"), -F.col("c_custkey"), F.concat(F.lit("# "), "c_name")))
    return tables.parse_reference(lines).select("witness", "unit", "chapter", "kind", "text", "flag")


#: Documents' languages read as those that have a length of their own.
READ_AS = {"en": "zh", "de": "bo", "fr": "sa"}
PUNCT = T.ZH_PUNCT.replace("'", "''")
SA = "regexp_replace(nfc_normalize(lower(text)), '[|।॥0-9.\\-()\\[\\]]+', ' ', 'g')"


@query(
    f"""SELECT lang, count(*) AS docs, sum(CASE lang WHEN 'en' THEN len(translate(text, '{PUNCT}', ''))
  WHEN 'de' THEN len(list_filter(string_split_regex(text, '{T.BO_SPLIT}'), lambda x: x <> ''))
  WHEN 'fr' THEN len(regexp_extract_all({SA}, '{T.SA_VOWELS}')) ELSE {WORDS.format('text')} END)::BIGINT AS length FROM documents GROUP BY lang"""
)
def length_by_lang(spark: SparkSession, d: str) -> DataFrame:
    """Lengths by the rules of three languages and by words, one for each language of the documents."""
    lang = F.coalesce(*(F.when(F.col("lang") == k, v) for k, v in READ_AS.items()), F.lit("xx"))
    return D.table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("docs"), F.sum(T.length_in(F.col("text"), lang)).alias("length"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def file_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return D.table(spark, d, "documents").select("doc_id", tables.digest(F.col("text")).alias("sha256"))


# ---- identifiers

UNIT_IDS = [
    ("I.5.12", "verse"), ("I.5.12a", "verse"), ("I.1.p03", "prose"), ("II.12.t0012", "provisional"), ("L.81.p01", "prose"),
    ("+zh:a-b", "orphan"), ("I.12.1", None), ("bad", None), ("L.64.2b", "verse"),
]


@query(
    "SELECT * FROM (VALUES " + ", ".join(
        f"('{u}', {repr(k) if k else 'NULL'}, {repr(u) if k else 'NULL'})" for u, k in UNIT_IDS
    ) + ") t(unit, kind, again)"
)
def id_codec_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    u = _values(spark, [(x,) for x, _ in UNIT_IDS], "unit string").withColumn("u", ids.parse(F.col("unit")))
    return u.select("unit", F.col("u.kind").alias("kind"), ids.render(F.col("u")).alias("again"))


ORDERED = ["I.1.1", "I.1.1a", "I.1.2", "I.1.p01", "I.1.t0001", "I.2.1", "II.1.1", "+bo:1a", "+zh:x", "L.1.p01", "L.2.p01"]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{u}', {i + 1})" for i, u in enumerate(ORDERED)) + ") t(unit, place)")
def unit_sort_order(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    u = _values(spark, [(x,) for x in sorted(ORDERED)], "unit string").withColumn("key", ids.sort_key(F.col("unit")))
    return u.select("unit", F.row_number().over(Window.orderBy("key")).alias("place"))


# ---- numerals and lengths, against hand-checked values

ZH = [("三十二", "32"), ("十", "10"), ("百", "100"), ("一百八", "108"), ("萬", "0"), ("十萬", "100000"), ("二三", "3"), ("二十一", "21")]
ZH_SETS = [("彼血脈相有三十二種", "32"), ("一百八千二", "8102"), ("一人", ""), ("有十有二", "2,10"), ("", "")]
BO_SETS = [("སུམ་ཅུ་རྩ་གཉིས་", "32"), ("བཅུ་ལྔ་དང་བརྒྱ་", "15,100"), ("གཅིག་", ""), ("བཅུ་གསུམ་", "13"), ("ཉི་ཤུ་", "20")]
SA_LENGTHS = [("dvātriṃśan nāḍyaḥ", "5"), ("vajragarbha mahāsattva", "8"), ("oṃ hūṃ phaṭ", "3"), ("", "0"), ("kailāsa", "3")]
SA_SETS = [("dvātriṃśan nāḍyaḥ", "32"), ("pañca daśa", "5,10"), ("caturviṃśati", "24"), ("eka", "")]


def _numbers(c):
    return F.array_join(F.transform(c, lambda n: n.cast("string")), ",")


@query(_golden(ZH))
def zh_numerals_golden(spark: SparkSession, d: str) -> DataFrame:
    return _values(spark, [(a,) for a, _ in ZH], "input string").select("input", T.zh_number(F.col("input")).cast("string").alias("value"))


@query(_golden(ZH_SETS))
def zh_numeral_sets_golden(spark: SparkSession, d: str) -> DataFrame:
    return _values(spark, [(a,) for a, _ in ZH_SETS], "input string").select("input", _numbers(T.zh_numbers(F.col("input"))).alias("value"))


@query(_golden(BO_SETS))
def bo_numerals_golden(spark: SparkSession, d: str) -> DataFrame:
    return _values(spark, [(a,) for a, _ in BO_SETS], "input string").select("input", _numbers(T.bo_numbers(F.col("input"))).alias("value"))


@query(_golden(SA_LENGTHS))
def sa_syllables_golden(spark: SparkSession, d: str) -> DataFrame:
    return _values(spark, [(a,) for a, _ in SA_LENGTHS], "input string").select("input", T.sa_length(F.col("input")).cast("string").alias("value"))


@query(_golden(SA_SETS))
def sa_numerals_golden(spark: SparkSession, d: str) -> DataFrame:
    return _values(spark, [(a,) for a, _ in SA_SETS], "input string").select("input", _numbers(T.sa_numbers(F.col("input"))).alias("value"))


# ---- anchors and similarity

FORMS = [
    ("thention", "name:a"), ("einlich", "name:b"), ("ación", "term:c"), ("tion", "term:d"), ("ing", "term:e"), ("eau", "term:f"),
    ("ung", "term:g"), ("the", "term:h"),
]
TERMS = lexicon.Lexicon(tuple(lexicon.Term(k.split(":")[1], k.split(":")[0], {"xx": (f,)}) for f, k in FORMS))


def _anchor_sql(text: str) -> str:
    """Nested replacement in the order of length: what is found is masked for the next."""
    masked, keys = text, []
    for f, k in sorted(FORMS, key=lambda x: -len(x[0])):
        keys.append(f"CASE WHEN contains({masked}, '{f}') THEN '{k}' END")
        masked = f"replace({masked}, '{f}', '{'#' * len(f)}')"
    return f"list_sort(list_filter([{', '.join(keys)}], lambda x: x IS NOT NULL))"


@query(f"SELECT doc_id, array_to_string({_anchor_sql('text')}, ' ') AS anchors FROM documents")
def anchor_extract(spark: SparkSession, d: str) -> DataFrame:
    return D.table(spark, d, "documents").select("doc_id", F.array_join(TERMS.anchors(F.col("text"), "xx"), " ").alias("anchors"))


@query(f"""WITH a AS (SELECT conv_id, turn, {_anchor_sql('text')} AS k FROM conversations), p AS (SELECT x.conv_id, x.turn, x.k AS a, y.k AS b
  FROM a x JOIN a y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1)
SELECT conv_id, turn, round(CASE WHEN len(list_distinct(list_concat(a, b))) > 0 THEN len(list_intersect(a,
  b)) / len(list_distinct(list_concat(a, b))) ELSE 0 END, 4)::DOUBLE AS similarity FROM p""")
def anchor_jaccard(spark: SparkSession, d: str) -> DataFrame:
    a = D.table(spark, d, "conversations").select("conv_id", "turn", TERMS.anchors(F.col("text"), "xx").alias("k"))
    b = a.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("k").alias("b"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.round(S.jaccard(F.col("k"), F.col("b")), 4).alias("similarity"))


PAIRS = [("é", "e"), ("è", "e"), ("ê", "e"), ("ä", "a"), ("ö", "o"), ("ü", "u"), ("ß", "s"), ("ñ", "n"), ("ó", "o"), ("í", "i")]


@query(f"SELECT doc_id, md5(translate(text, '{''.join(a for a, _ in PAIRS)}', '{''.join(b for _, b in PAIRS)}')) AS digest FROM documents")
def variant_translate(spark: SparkSession, d: str) -> DataFrame:
    return D.table(spark, d, "documents").select("doc_id", F.md5(T.Variants(PAIRS).normalize(F.col("text"))).alias("digest"))


@query("SELECT * FROM (VALUES ('道可道非恆道', '道可道非常道', '恆=常'), ('邦家', '國家之', '邦=國'), ('上善', '上善', '')) t(a, b, explained)")
def variants_explained(spark: SparkSession, d: str) -> DataFrame:
    v = T.Variants([("恆", "常"), ("邦", "國")])
    rows = _values(spark, [("道可道非恆道", "道可道非常道"), ("邦家", "國家之"), ("上善", "上善")], "a string, b string")
    return rows.select("a", "b", F.array_join(v.explained(F.col("a"), F.col("b")), " ").alias("explained"))


def gram_sql(c: str, n: int) -> str:
    return f"list_distinct(list_transform(range(1, greatest(0, len({c}) - {n} + 1) + 1), lambda i: substr({c}, i, {n})))"


def dice_sql(a: str, b: str) -> str:
    g = {x: f"list_distinct(list_concat({gram_sql(x, 1)}, CASE WHEN len({x}) < 2 THEN [{x}] ELSE {gram_sql(x, 2)} END))" for x in (a, b)}
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN 2.0::DOUBLE * len(list_intersect({g[a]}, {g[b]})) / (len({g[a]}) + len({g[b]})) ELSE 0.0::DOUBLE END"


@query(
    f"""WITH p AS (SELECT x.conv_id, x.turn, x.text AS a, y.text AS b
  FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1)
  SELECT conv_id, turn, round({dice_sql('a', 'b')}, 4) AS dice FROM p"""
)
def dice_bigram(spark: SparkSession, d: str) -> DataFrame:
    a = D.table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("a"))
    b = a.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.round(S.dice(F.col("a"), F.col("b")), 4).alias("dice"))


def _gram_sql(name: str, source: str, keys: str, n: int) -> str:
    return f"""{name} AS (SELECT DISTINCT {keys}, g FROM (SELECT {keys}, string_agg(c,
  '') OVER (PARTITION BY {keys.split(',')[0]} ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) AS g
  FROM (SELECT {keys}, unnest(cs) AS c, unnest(range(len(cs))) AS i
  FROM (SELECT {keys}, string_split(regexp_replace(trim(text), '\\s+', ' ', 'g'), '') AS cs FROM {source}))) WHERE len(g) = {n})"""


PROBE_SQL = f"""{_gram_sql('tg', 'benchmark', 'item_id', 16)}, {_gram_sql('og', 'documents', 'doc_id, source', 16)},
n AS (SELECT item_id, count(*) AS n FROM tg GROUP BY item_id), ov AS (SELECT doc_id, source, item_id, count(*) / any_value(n.n) AS overlap
  FROM og JOIN tg USING (g) JOIN n USING (item_id) GROUP BY ALL)"""


def _overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Recall of each benchmark item's 16-grams in each document that has any.

    The benchmark's grams are joined to the documents', so nothing is compared that shares no gram.
    """
    n = 16

    def grams(df: DataFrame, *keys: str) -> DataFrame:
        return S.gram_rows(df.select(*keys, S.squeeze(F.col("text")).alias("text")), list(keys), "text", n)

    truth = grams(D.table(spark, d, "benchmark"), "item_id")
    met = grams(D.table(spark, d, "documents"), "doc_id", "source").join(truth, "g")
    size = truth.groupBy("item_id").agg(F.count("*").alias("n"))
    return met.groupBy("doc_id", "source", "item_id").agg(F.count("*").alias("hits")).join(size, "item_id").select(
        "doc_id", "source", "item_id", (F.col("hits") / F.col("n")).alias("overlap"),
    )


@query(f"WITH {PROBE_SQL} SELECT doc_id, item_id, round(overlap, 4) AS recall FROM ov")
def ngram_recall(spark: SparkSession, d: str) -> DataFrame:
    return _overlaps(spark, d).select("doc_id", "item_id", F.round("overlap", 4).alias("recall"))


@query(
    f"""WITH {PROBE_SQL} SELECT source, count(*) AS n, round(avg(round(overlap, 3)), 4) AS mean_overlap, round(CASE
  WHEN grouping(source) = 1 THEN avg((overlap >= 0.5::DOUBLE)::INT)
  ELSE avg((round(overlap, 3) >= 0.5::DOUBLE)::INT) END, 4) AS memorised_rate, grouping(source)::INT AS overall FROM ov GROUP BY ROLLUP (source)"""
)
def contamination_probe(spark: SparkSession, d: str) -> DataFrame:
    return A.contamination(_overlaps(spark, d))


ACCENTS = "".join(a for a, _ in PAIRS)
TRANSLIT = lexicon.Lexicon((lexicon.Term("tion", "term", {"zh": ("tion", "ionti")}, True), lexicon.Term("x", "term", {"zh": ("the",)})), ACCENTS)


@query(f"""WITH c AS (SELECT doc_id, translate(text, '{PUNCT}', '') AS c
  FROM documents), m AS (SELECT doc_id, len(c) AS n, list_sum(list_transform(regexp_extract_all(c, '[{ACCENTS}]{{2,}}'),
  lambda r: len(r))) AS runs, string_split(replace(c, 'tion', chr(1) || chr(1) || chr(1) || chr(1)), '') AS a, string_split(replace(c,
  'ionti', chr(1) || chr(1) || chr(1) || chr(1) || chr(1)), '') AS b FROM c)
SELECT doc_id, round(CASE WHEN n > 0 THEN (coalesce(runs, 0) + len(list_filter(list_zip(a, b),
  lambda x: x[1] = chr(1) OR x[2] = chr(1)))) / n ELSE 0 END, 6)::DOUBLE AS density FROM m""")
def translit_density(spark: SparkSession, d: str) -> DataFrame:
    """Characters inside either of two overlapping forms, or beside another accented one."""
    return D.table(spark, d, "documents").select("doc_id", F.round(TRANSLIT.density(F.col("text"), "zh"), 6).alias("density"))


SAID = {0: " The translator deliberately removed it.", 1: " 此處有意省略。", 2: " It was toned down."}


@query(
    f"""SELECT doc_id, regexp_matches(text || CASE doc_id % 7 {' '.join(f'WHEN {k} THEN {v!r}' for k, v in SAID.items())}
  ELSE '' END, '(?i){'|'.join(A.MOTIVES)}') AS motive FROM documents WHERE text IS NOT NULL"""
)
def motive_flag(spark: SparkSession, d: str) -> DataFrame:
    """Documents of which some are given a sentence that names a motive."""
    more = F.coalesce(*(F.when(F.col("doc_id") % 7 == k, v) for k, v in SAID.items()), F.lit(""))
    return D.table(spark, d, "documents").where("text is not null").select("doc_id", A.asserts_motive(F.concat("text", more)).alias("motive"))


# ---- guarded model output


@query("SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events")
def tolerant_json(spark: SparkSession, d: str) -> DataFrame:
    """An event's JSON, wrapped in thoughts and a fence, read back."""
    said = F.concat(F.lit("<think>{\"k\": -1}</think>Sure:\n```json\n"), F.col("props"), F.lit("\n``` done"))
    return D.table(spark, d, "events").select("event_id", G.answer(said, "k bigint")["k"].alias("k"))


@query(
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 'action' ELSE '' END AS lost,
  CASE WHEN event_type = 'click' THEN 'result' ELSE '' END AS added, CASE WHEN event_type = 'error' THEN 0.5 ELSE 0.0 END::DOUBLE AS loss_rate FROM events"""
)
def component_deviation(spark: SparkSession, d: str) -> DataFrame:
    e = D.table(spark, d, "events")
    none = F.array().cast("array<string>")
    some = F.array(F.lit("x"))
    ref = F.create_map(F.lit("actor"), some, F.lit("action"), some, F.lit("result"), none)
    wit = F.create_map(
        F.lit("actor"), some, F.lit("action"), F.when(F.col("event_type") == "error", none).otherwise(some), F.lit("result"),
        F.when(F.col("event_type") == "click", some).otherwise(none),
    )
    c = e.select("event_id", G.component_deviation(ref, wit).alias("c"))
    return c.select("event_id", F.array_join("c.lost", " ").alias("lost"), F.array_join("c.added", " ").alias("added"), "c.loss_rate")


@query(
    f"WITH {D.LINES} SELECT doc_id, seq, substr(trim(text), 1, 40) AS prefix, len(trim(text))::BIGINT - 40 AS rest FROM lines WHERE len(trim(text)) >= 80"
)
def probe_items(spark: SparkSession, d: str) -> DataFrame:
    p = D.lines(spark, d).select("doc_id", "seq", G.probe_items(F.col("text")).alias("p")).where("p is not null")
    return p.select("doc_id", "seq", "p.prefix", F.length("p.continuation").cast("long").alias("rest"))


def echo(prompt: str) -> str:
    """A model that says the last forty characters it was given."""
    return prompt[-40:]


PROBED = """(SELECT item_id, regexp_replace(substr(t, 41), '\\s+', ' ', 'g') AS b, regexp_replace(substr(t, 1, 40), '\\s+', ' ', 'g') AS a
  FROM (SELECT item_id, trim(text) AS t FROM benchmark) WHERE len(t) >= 80)"""


@query(
    f"""WITH p AS (SELECT item_id, trim(b) AS b, trim(a) AS a
  FROM {PROBED}) SELECT item_id::VARCHAR AS ref, round(CASE
  WHEN len(b) >= 4 THEN len(list_intersect({gram_sql('b', 4)}, {gram_sql('a', 4)})) / len({gram_sql('b', 4)}) ELSE 0 END, 4)::DOUBLE AS overlap FROM p"""
)
def mock_probe(spark: SparkSession, d: str) -> DataFrame:
    """The memorisation probe end to end, with a model that repeats the prefix."""
    items = D.table(spark, d, "benchmark").select(F.lit("benchmark").alias("source"), F.col("item_id").cast("string").alias("ref"), "text")
    return J.probe(items, J.Mock(respond=echo)).select("ref", F.round("overlap", 4).alias("overlap"))


# ---- model-backed roles, with models that answer the same to all


def _says(answer: dict) -> J.Mock:
    return J.Mock(respond=lambda prompt: json.dumps(answer))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return D.lines(spark, d).select("doc_id", "seq", "text", F.lit("xx").alias("lang"), F.array(F.lit("name:a"), F.lit("term:b")).alias("anchors"))


@query(
    f"""WITH {D.LINES} SELECT doc_id, seq, CASE WHEN contains(text, 'the') THEN 'the' ELSE '' END AS actor,
  CASE WHEN contains(text, 'que') THEN 'que que' ELSE '' END AS action,
  CASE WHEN contains(text, 'the') THEN '' ELSE 'actor:the' END || '|' ||
  CASE WHEN contains(text, 'que') THEN '' ELSE 'action:que action:que' END AS rejected, 'term:b' AS keys FROM lines"""
)
def mock_components(spark: SparkSession, d: str) -> DataFrame:
    """Slots hold what the text says word for word; keys are those that were offered."""
    got = J.extract_components(_lines(spark, d), _says({"actor": [" the "], "action": ["que", "que"], "lexicon_keys": ["term:b", "bogus"]}))
    parts = [F.array_join(F.filter("rejected", _begins(slot)), " ") for slot in ("actor", "action")]
    return got.select(
        "doc_id", "seq", *(F.array_join(F.col("slots")[x], " ").alias(x) for x in ("actor", "action")),
        F.concat(parts[0], F.lit("|"), parts[1]).alias("rejected"), F.array_join("lexicon_keys", " ").alias("keys"),
    )


def _begins(slot: str):
    return lambda x: x.startswith(f"{slot}:")


@query(f"WITH {D.LINES} SELECT doc_id, seq, 'other' AS topic, CASE WHEN contains(text, 'und') THEN 'und' ELSE '' END AS cues FROM lines")
def mock_topics(spark: SparkSession, d: str) -> DataFrame:
    got = J.label_topics(_lines(spark, d), _says({"topic": "heresy", "cues": ["und", "never said"]}))
    return got.select("doc_id", "seq", "topic", F.array_join("cues", " ").alias("cues"))


@query(f"WITH {D.LINES} SELECT doc_id, seq, text AS propositions FROM lines")
def mock_segmentation(spark: SparkSession, d: str) -> DataFrame:
    """Pieces that do not tile the text are not taken: the text stays whole."""
    return J.segment(_lines(spark, d), _says({"propositions": ["in no text", "nor this"]})).select(
        "doc_id", "seq", F.array_join("propositions", "|").alias("propositions"),
    )


FACTS = "SELECT event_id, CASE WHEN event_type = 'error' THEN '' ELSE event_type || ': PRESENT' END AS facts FROM events"


@query(
    f"""SELECT event_id::VARCHAR AS unit, CASE WHEN facts = '' THEN 'abstain' ELSE 'shared_with_cowitness' END AS top,
  CASE WHEN facts = '' THEN 0.0 ELSE 0.75 END::DOUBLE AS share, CASE WHEN facts = '' THEN '' ELSE '1' END AS cited FROM ({FACTS})"""
)
def mock_attribution(spark: SparkSession, d: str) -> DataFrame:
    """Shares add up to 1; facts that do not exist are not cited; without facts there is no answer."""
    e = D.table(spark, d, "events").select(
        F.col("event_id").cast("string").alias("unit"),
        F.when(F.col("event_type") == "error", "").otherwise(F.concat("event_type", F.lit(": PRESENT"))).alias("facts"),
    )
    got = J.judge_attribution(
        e,
        _says({"distribution": {"shared_with_cowitness": 3, "abstain": "1", "lacuna": -2}, "cited_facts": [1, 9], "note": "as the facts say"}),
    )
    return got.select(
        "unit", "top", F.col("distribution")["shared_with_cowitness"].alias("share"),
        F.array_join(F.transform("cited", lambda x: x.cast("string")), " ").alias("cited"),
    )


@query("SELECT item_id::VARCHAR AS unit, 'It was toned down.' AS rationale, true AS motive FROM benchmark")
def mock_rationale(spark: SparkSession, d: str) -> DataFrame:
    cells = D.table(spark, d, "benchmark").select(
        F.col("item_id").cast("string").alias("unit"), F.lit("w").alias("witness"), F.lit("ABSENT").alias("status"),
    )
    return J.explain(cells, J.Mock(respond=lambda p: "<think>hm</think> It was toned down.")).select("unit", "rationale", "motive")


@query(
    """SELECT 'naive' AS model, count(*) AS n, 1.0::DOUBLE AS rate_a, 0.0::DOUBLE AS rate_b, 1.0::DOUBLE AS diff
  FROM benchmark UNION ALL SELECT 'stubborn', count(*), 1.0, 1.0, 0.0 FROM benchmark"""
)
def mock_counterfactual(spark: SparkSession, d: str) -> DataFrame:
    """Does a model stop naming motives when it is told that others lack the unit too?"""
    items = D.table(spark, d, "benchmark").select(
        F.col("item_id").cast("string").alias("unit"), F.col("text").alias("source_text"), F.lit("another one lacks it").alias("fact"),
    )
    models = [
        J.Mock("naive", lambda p: "A variant reading." if "Additional fact" in p else "This is censorship."),
        J.Mock("stubborn", lambda p: "Censorship."),
    ]
    return A.counterfactual_rates(J.counterfactual(items, models))


@query(
    f"""SELECT sha256(r_name) AS prompt_sha256, sha256('mock response') AS response_sha256,
  sha256('{J.SYSTEM.replace(chr(39), chr(39) * 2)}') AS system_sha256, 'mock' AS model_id, len(r_name)::INT AS n_prompt_chars,
  13::INT AS n_response_chars, 64::INT AS max_tokens FROM region"""
)
def call_records(spark: SparkSession, d: str) -> DataFrame:
    asked = J.ask(D.table(spark, d, "region").select("r_name"), F.col("r_name"), J.Mock(), None, 64)
    return J.call_log(asked).select(
        "prompt_sha256", "response_sha256", "system_sha256", "model_id", "n_prompt_chars", "n_response_chars", "max_tokens",
    )


# ---- vectors


CENTROIDS = """c AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL) GROUP BY label, i), v AS (SELECT label, list(m ORDER BY i) AS v FROM c GROUP BY label)"""


@query(f"WITH {CENTROIDS} SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], v), 4) AS similarity FROM embeddings JOIN v USING (label)")
def embedding_centroid_cos(spark: SparkSession, d: str) -> DataFrame:
    return _centroid(spark, d).select("vec_id", F.round("similarity", 4).alias("similarity"))


def _centroid(spark: SparkSession, d: str) -> DataFrame:
    e = D.table(spark, d, "embeddings").where("label is not null and embedding is not null")
    parts = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    v = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("v"))
    return e.join(v, "label").select("vec_id", "label", S.cosine(F.col("embedding").cast("array<double>"), F.col("v")).alias("similarity"))


KEYS = "[('k' || vec_id % 5), ('num:' || label % 3)] AS a, [('k' || label % 5), ('num:' || vec_id % 3)] AS b"


@query(f"""WITH {CENTROIDS}, k AS (SELECT vec_id, label, embedding, {KEYS}
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL), w AS (SELECT *, (a[1] = b[1])::INT + 2 * (a[2] = b[2])::INT AS hits FROM k)
SELECT vec_id, round(greatest(hits / (6.0::DOUBLE - hits), 0.8::DOUBLE * greatest(0, list_cosine_similarity(embedding::DOUBLE[], v))),
  4) AS similarity FROM w JOIN v USING (label)""")
def hybrid_similarity(spark: SparkSession, d: str) -> DataFrame:
    """The larger of anchor similarity, numbers weighing double, and the weighted cosine."""
    s = _centroid(spark, d)

    def keys(x: str, y: str):
        return F.array(F.concat(F.lit("k"), (F.col(x) % 5).cast("string")), F.concat(F.lit("num:"), (F.col(y) % 3).cast("string")))

    anchor = S.jaccard(keys("vec_id", "label"), keys("label", "vec_id"))
    return s.select("vec_id", F.round(S.hybrid(anchor, F.greatest(F.lit(0.0), F.col("similarity"))), 4).alias("similarity"))


# ---- functions against hand-checked values

SYLLABLES, MANTRA = "རྩ་ནི་སུམ་ཅུ།", "ཨོཾ་ཧཱུྃ་ཕཊ།"
TEXTS = [
    ("zh_strip", "彼，血。（脈）", "彼血脈"), ("zh_length", "彼，血。", "2"), ("bo_length", SYLLABLES, "4"), ("bo_share", MANTRA, "1.0"), ("bo_share", SYLLABLES, "0.0"), ("strip_marks", " 絕智，「棄」辯。", "絕智棄辯"),
    ("lacuna", "□□道，□", "0.75"), ("lacuna", "", "0.0"), ("sa", " Evaṃ  Mayā|12. ", "evaṃ mayā"), ("length_zh", "道可道，", "3"), ("length_bo", SYLLABLES, "4"), ("length_sa", "oṃ hūṃ", "2"), ("length_xx", "two words", "2"),
    ("numbers_zh", "三十二", "32"), ("numbers_bo", "བཅུ་ལྔ", "15"), ("numbers_sa", "pañca", "5"), ("numbers_xx", "5", ""), ("density_zh", "金剛拏吉尼", "0.6"), ("density_zh", "拏金", "0.0"), ("density_bo", MANTRA, "1.0"), ("density_sa", "oṃ", "0.0"),
    ("kind", "ལེའུ་སྟེ་དང་པོའོ།", "colophon"), ("kind", MANTRA, "mantra"), ("kind", SYLLABLES, "prose"), ("ordinal", "རིགས་ཀྱི་ལེའུ་སྟེ་དང་པོའོ།", "1"), ("ordinal", "ལེའུ་སྟེ་བཅུ་གཉིས་པའོ།", "12"), ("ordinal", "རྫོགས་སོ།", None),
]
CLASSED = lexicon.Lexicon((), "拏吉尼")
CALLS = {
    "zh_strip": T.zh_strip, "zh_length": T.zh_length, "bo_length": T.bo_length, "bo_share": T.bo_sanskrit_share, "strip_marks": T.strip_marks, "lacuna": T.lacuna_share, "sa": T.sa_normalize, "kind": folio.classify, "ordinal": folio.ordinal,
    **{f"length_{x}": (lambda c, x=x: T.length_in(c, F.lit(x))) for x in ("zh", "bo", "sa", "xx")}, **{
        f"numbers_{x}": (lambda c, x=x: _numbers(T.numbers_in(c, F.lit(x)))) for x in ("zh", "bo", "sa", "xx")
    },
    **{f"density_{x}": (lambda c, x=x: CLASSED.density_in(c, F.lit(x))) for x in ("zh", "bo", "sa")},
}


def _sql_rows(rows: list[tuple], names: str) -> str:
    cells = ", ".join("(" + ", ".join("NULL" if v is None else "'" + str(v).replace("'", "''") + "'" for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {cells}) t({names})"


@query(_sql_rows([(f, t, v) for f, t, v in TEXTS], "fn, input, value"))
def text_functions_golden(spark: SparkSession, d: str) -> DataFrame:
    rows = _values(spark, [(f, t) for f, t, _ in TEXTS], "fn string, input string")
    value = F.coalesce(*(F.when(F.col("fn") == name, call(F.col("input")).cast("string")) for name, call in CALLS.items()))
    return rows.select("fn", "input", value.alias("value"))


SAID_ROWS = [
    ("clamp", "1.7", "1.0"), ("clamp", "x", "0.0"), ("clamp", "-2", "0.0"), ("closed", "accept", "accept"), ("closed", "definitely", "unsure"), ("shares", '{"lacuna": 1, "abstain": 3}', "0.25"), ("shares", "{}", "0.0"),
    ("tiles", '["甲乙。", "丙丁。"]', "甲乙。|丙丁。"), ("tiles", '["丙丁。", "甲乙。"]', "甲乙。丙丁。"), ("verbatim", '[" 甲乙 ", "戊"]', "甲乙"), ("invented", '["甲", "戊"]', "戊"),
]


@query(_sql_rows(SAID_ROWS, "fn, input, value"))
def guards_golden(spark: SparkSession, d: str) -> DataFrame:
    rows = _values(spark, [(f, t) for f, t, _ in SAID_ROWS], "fn string, input string")
    said, text, names = F.col("input"), F.lit("甲乙。丙丁。"), ("lacuna", "abstain")
    listed = F.coalesce(F.from_json(F.when(said.startswith("["), said), "array<string>"), F.array().cast("array<string>"))
    shares = F.coalesce(F.from_json(F.when(said.startswith("{"), said), "map<string,string>"), F.create_map().cast("map<string,string>"))
    value = (
        F.when(F.col("fn") == "clamp", G.unit_interval(said).cast("string"))
        .when(F.col("fn") == "closed", G.one_of(said, G.VERDICTS, "unsure"))
        .when(F.col("fn") == "shares", G.distribution(shares, names, "abstain")["lacuna"].cast("string"))
        .when(F.col("fn") == "tiles", F.array_join(G.tiles(listed, text), "|"))
        .when(F.col("fn") == "verbatim", F.array_join(G.verbatim(listed, text), "|"))
        .when(F.col("fn") == "invented", F.array_join(G.invented(listed, text), "|"))
    )
    return rows.select("fn", "input", value.alias("value"))


@query("SELECT '(c:2.0000,(a:0.5000,b:0.5000):1.5000);' AS newick")
def upgma_golden(spark: SparkSession, d: str) -> DataFrame:
    """Average linkage of three witnesses, worked out by hand."""
    return _values(spark, [(X.tree(["a", "b", "c"], {("a", "b"): 1.0, ("a", "c"): 4.0, ("b", "c"): 4.0}),)], "newick string")


# ---- sinks, written and read back


@query("SELECT r_name, n_name, n_nationkey::VARCHAR AS n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A table through the CSV sink and the CSV source."""
    rows = D.table(spark, d, "nation").join(
        D.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"),
    ).select("r_name", "n_name", "n_nationkey")
    path = scratch(spark, "csv")
    report.write_csv(rows, path)
    return tables.read_csv(spark, path, rows.columns)


@query("SELECT doc_id, source, text FROM documents")
def jsonl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Documents, with whatever their texts hold, through the JSON lines sink."""
    rows = D.table(spark, d, "documents").select("doc_id", "source", "text")
    path = scratch(spark, "jsonl")
    report.write_jsonl(rows, path)
    return spark.read.schema(rows.schema).json(path)
