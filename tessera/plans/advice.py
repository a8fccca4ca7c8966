"""Queries on review, comparison and relevance of runs, notes, image labels, text fields and vocabularies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import advice, images, knowledge, reports, text, textmodels
from .tables import read
from .texts import TOKENS

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# --- runs: each order is one, and is compared with the one before it of its customer

SHARES = {"accuracy": "(o_orderkey % 101) / 100.0", "roc_auc": "(o_orderkey % 97) / 96.0", "f1_weighted": "(o_orderkey % 89) / 88.0", "train_score": "(o_orderkey % 13) / 12.0", "test_score": "(o_orderkey % 11) / 10.0"}


def runs(spark, d):
    share = lambda m, k: (F.col("o_orderkey") % m) / float(k)
    metrics = F.create_map(*[x for name, (m, k) in {"accuracy": (101, 100), "roc_auc": (97, 96), "f1_weighted": (89, 88), "train_score": (13, 12), "test_score": (11, 10)}.items() for x in (F.lit(name), share(m, k))])
    metrics = F.when(F.col("o_orderkey") % 5 == 0, F.map_filter(metrics, lambda k, _: k != "roc_auc")).otherwise(metrics)
    params = F.create_map(F.lit("priority"), F.col("o_orderpriority"), F.lit("status"), F.col("o_orderstatus"))
    importances = F.map_from_entries(F.transform(F.sequence(F.lit(0), 5 + F.col("o_orderkey") % 9), lambda i: F.struct(F.concat(F.lit("f"), i.cast("string")), ((F.col("o_orderkey") * i) % 4 / 4.0))))
    return read(spark, d, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("customer"), (F.col("o_custkey") % 3).alias("dataset_id"), F.col("o_orderstatus").alias("target"), F.col("o_orderpriority").alias("model_name"), F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderstatus") == "F", "classification").otherwise("regression").alias("task"), (F.col("o_orderkey") % 1000).alias("n_train"), (F.col("o_orderkey") % 3).alias("n_removed"), (F.col("o_orderkey") % 7 == 0).alias("leaks"), metrics.alias("metrics"), params.alias("params"), importances.alias("importances"),
    )


def pairs(runs):
    from pyspark.sql import Window

    before = F.lag("job_id").over(Window.partitionBy("customer").orderBy("created_at", "job_id"))
    return runs.select(before.alias("a"), F.col("job_id").alias("b")).where("a IS NOT NULL")


PAIRS = "p AS (SELECT * FROM (SELECT lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS a, o_orderkey AS b FROM orders) WHERE a IS NOT NULL)"
METRICS = "m AS (" + " UNION ALL ".join(f"SELECT a, b, '{n}' AS metric, CAST({s.replace('o_orderkey', 'a')} AS DOUBLE) AS x, CAST({s.replace('o_orderkey', 'b')} AS DOUBLE) AS y FROM p" + (" WHERE a % 5 <> 0 AND b % 5 <> 0" if n == "roc_auc" else "") for n, s in SHARES.items()) + ")"


@query("compare_metrics", f"WITH {PAIRS}, {METRICS} SELECT a, b, metric, round(x, 4) AS run_a, round(y, 4) AS run_b, round(y - x, 4) AS delta, CASE WHEN x <> 0 THEN round(100 * (y - x) / abs(x), 2) END AS pct_change, CASE WHEN y > x THEN CAST(b AS VARCHAR) WHEN y < x THEN CAST(a AS VARCHAR) ELSE 'tie' END AS winner FROM m")
def _(spark, d):
    r = runs(spark, d)
    return advice.compare_metrics(r, pairs(r))


@query("compare_params", f"WITH {PAIRS}, x AS (SELECT p.a, p.b, s.o_orderpriority AS pa, t.o_orderpriority AS pb, s.o_orderstatus AS sa, t.o_orderstatus AS sb FROM p JOIN orders s ON s.o_orderkey = a JOIN orders t ON t.o_orderkey = b) SELECT a, b, 'priority' AS param, pa AS run_a, pb AS run_b FROM x WHERE pa <> pb UNION ALL SELECT a, b, 'status', sa, sb FROM x WHERE sa <> sb")
def _(spark, d):
    r = runs(spark, d)
    return advice.compare_params(r, pairs(r))


@query("compare_importances", f"WITH {PAIRS}, f AS (SELECT o_orderkey AS job, 'f' || i AS feature, (o_orderkey * i) % 4 / 4.0 AS v FROM (SELECT o_orderkey, unnest(range(0, CAST(6 + o_orderkey % 9 AS BIGINT))) AS i FROM orders)), u AS (SELECT p.a, p.b, feature FROM p JOIN f ON f.job = p.a UNION SELECT p.a, p.b, feature FROM p JOIN f ON f.job = p.b), k AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY feature) <= 10) SELECT k.a, k.b, k.feature, CAST(x.v AS DOUBLE) AS importance_a, CAST(y.v AS DOUBLE) AS importance_b FROM k LEFT JOIN f x ON x.job = k.a AND x.feature = k.feature LEFT JOIN f y ON y.job = k.b AND y.feature = k.feature WHERE x.v IS DISTINCT FROM y.v")
def _(spark, d):
    r = runs(spark, d)
    return advice.compare_importances(r, pairs(r))


@query("compare_setups", f"WITH {PAIRS} SELECT a, b, s.o_custkey % 3 = t.o_custkey % 3 AS same_dataset, s.o_orderstatus = t.o_orderstatus AS same_target, s.o_orderpriority <> t.o_orderpriority AS model_changed FROM p JOIN orders s ON s.o_orderkey = a JOIN orders t ON t.o_orderkey = b")
def _(spark, d):
    r = runs(spark, d)
    return advice.compare_setups(r, pairs(r))


FLAGS = {
    "clear_winner": "gap >= 0.02", "strong_cv": "best >= 0.85", "solid_f1": "cls AND f1 >= 0.85", "high_auc": "cls AND auc >= 0.9", "fewer_features": "k % 3 > 0",
    "close_race": "gap < 0.02 AND second IS NOT NULL", "weak_cv": "best < 0.7", "majority_bias": "cls AND acc > 0.95 AND auc < 0.75", "small_sample": "k % 1000 < 500", "leaks_found": "k % 7 = 0", "overfit": "tr <> 0 AND te <> 0 AND tr - te > 0.08",
}
_N = lambda names: " + ".join(f"CAST({FLAGS[n]} AS INTEGER)" for n in names)
STRONG, WEAK = list(FLAGS)[:5], list(FLAGS)[5:]


@query("run_flags", "WITH s AS (SELECT l_orderkey AS k, l_discount * 10 AS score, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC) AS n FROM lineitem), "
       f"x AS (SELECT o_orderkey AS k, o_orderstatus = 'F' AS cls, {SHARES['accuracy']} AS acc, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE {SHARES['roc_auc']} END AS auc, {SHARES['f1_weighted']} AS f1, {SHARES['train_score']} AS tr, {SHARES['test_score']} AS te, coalesce(a.score, 0) AS best, b.score AS second, coalesce(a.score - b.score, 0.1) AS gap FROM orders LEFT JOIN s a ON a.k = o_orderkey AND a.n = 1 LEFT JOIN s b ON b.k = o_orderkey AND b.n = 2) "
       f"SELECT k AS job_id, {', '.join(f'{v} AS {n}' for n, v in FLAGS.items())}, {_N(STRONG)} AS n_strengths, {_N(WEAK)} AS n_weaknesses, CASE WHEN {_N(WEAK)} <= 1 THEN 'pass' ELSE 'review' END AS verdict FROM x")  # fmt: skip
def _(spark, d):
    boards = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("model"), (F.col("l_discount") * 10).alias("score"))
    return advice.review_flags(runs(spark, d), boards)


# --- relevance: orders as past runs, nations as the contexts asked about

FEATURES = [["unit_price", "order status", "clerk"], ["status", "total_price", "ship-date"], ["Quantity", "discount"], []]
TARGETS = ["urgent", "5-LOW", "priority", "HIGH MEDIUM", "specified not"]
BUCKETS = ["small", "medium", "large", "xlarge"]
_LIST = lambda values: "[" + ", ".join("CAST([] AS VARCHAR[])" if v == [] else _LIST(v) if isinstance(v, list) else f"'{v}'" for v in values) + "]"
_TOK = lambda x: f"list_distinct(list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda t: length(t) > 2))"
_PLAIN = lambda x: f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', '_', 'g'), '_')"
_JAC = lambda a, b: f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END"
SIMILAR = (
    f"r AS (SELECT o_orderkey AS id, o_orderstatus AS task, {_PLAIN('o_orderpriority')} AS tg, {_TOK(f'array_to_string({_LIST(FEATURES)}[CAST(o_orderkey % 4 AS BIGINT) + 1], chr(32))' + ' || chr(32) || ' + chr(39) + 'sig' + chr(39) + ' || (o_orderkey % 9) || ' + chr(39) + ' col' + chr(39))} AS f, {_LIST(BUCKETS)}[CAST(o_custkey % 4 AS BIGINT) + 1] AS bucket, o_custkey % 40 AS ds, 'sig' || (o_orderkey % 9) || '|col' AS sig FROM orders), "
    f"c AS (SELECT -1 - n_nationkey AS id, ['F', 'O', 'P'][CAST(n_nationkey % 3 AS BIGINT) + 1] AS task, {_PLAIN(f'{_LIST(TARGETS)}[CAST(n_nationkey % 5 AS BIGINT) + 1]')} AS tg, {_TOK(f'array_to_string({_LIST(FEATURES)}[CAST(n_nationkey % 3 AS BIGINT) + 1], chr(32))')} AS f, {_LIST(BUCKETS)}[CAST(n_nationkey % 4 AS BIGINT) + 1] AS bucket, n_nationkey AS ds, 'sig' || (n_nationkey % 9) || '|col' AS sig FROM nation), "
    f"j AS (SELECT r.id AS run_id, c.id AS context_id, r.task = c.task AS t, CASE WHEN r.tg = c.tg THEN 1.0 WHEN contains(r.tg, c.tg) OR contains(c.tg, r.tg) THEN 0.75 ELSE {_JAC(_TOK('c.tg'), _TOK('r.tg'))} END AS name, {_JAC('c.f', 'r.f')} AS feat, r.bucket = c.bucket AS b, r.ds = c.ds AS d, r.sig = c.sig AS s FROM r CROSS JOIN c), "
    "k AS (SELECT *, 0.05 + 0.25 * t::INT + 0.3 * name + 0.3 * feat + 0.1 * b::INT + 0.15 * d::INT AS base FROM j), "
    "z AS (SELECT run_id, context_id, least(1.0, CASE WHEN name >= 0.5 OR feat >= 0.12 OR s OR d THEN CASE WHEN s THEN least(1.0, base + 0.2) ELSE base END ELSE least(CASE WHEN s THEN least(1.0, base + 0.2) ELSE base END, 0.22) END) AS similarity FROM k)"
)


def past_and_asked(spark, d):
    pick = lambda values, at: F.element_at(F.array(*[F.array(*map(F.lit, v)).cast("array<string>") if isinstance(v, list) else F.lit(v) for v in values]), (at + 1).cast("int"))
    signature = lambda k: F.concat(F.lit("sig"), (F.col(k) % 9).cast("string"), F.lit("|col"))
    past = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("task"), F.col("o_orderpriority").alias("target"), pick(FEATURES, F.col("o_orderkey") % 4).alias("features"), pick(BUCKETS, F.col("o_custkey") % 4).alias("row_bucket"), (F.col("o_custkey") % 40).cast("string").alias("dataset"), signature("o_orderkey").alias("signature"))
    asked = read(spark, d, "nation").select((-1 - F.col("n_nationkey")).alias("id"), pick(["F", "O", "P"], F.col("n_nationkey") % 3).alias("task"), pick(TARGETS, F.col("n_nationkey") % 5).alias("target"), pick(FEATURES, F.col("n_nationkey") % 3).alias("features"), pick(BUCKETS, F.col("n_nationkey") % 4).alias("row_bucket"), F.col("n_nationkey").cast("string").alias("dataset"), signature("n_nationkey").alias("signature"))
    return past, asked


def similarities(past, asked):
    return advice.run_similarity(past, asked).withColumn("similarity", F.round("similarity", 6))


@query("run_similarity", f"WITH {SIMILAR} SELECT run_id, context_id, round(CAST(similarity AS DOUBLE), 6) AS similarity FROM z")
def _(spark, d):
    return similarities(*past_and_asked(spark, d))


@query("comparable_runs", f"WITH {SIMILAR}, q AS (SELECT context_id, run_id, round(CAST(similarity AS DOUBLE), 6) AS similarity FROM z) SELECT context_id, run_id, similarity, CAST(row_number() OVER (PARTITION BY context_id ORDER BY similarity DESC, run_id) AS INTEGER) AS rank FROM q WHERE similarity >= 0.48 QUALIFY row_number() OVER (PARTITION BY context_id ORDER BY similarity DESC, run_id) <= 2")
def _(spark, d):
    past, asked = past_and_asked(spark, d)
    return advice.comparable_runs(similarities(advice.first_of_kinds(past, 2), asked))


COLUMNS = ["customer_name", "on_time", "ion", "The_Total"]


@query("tip_relevance", f"WITH t AS (SELECT DISTINCT text AS tip FROM benchmark), w AS (SELECT tip, {_TOK('tip')} AS w FROM t), o AS (SELECT {_TOK(repr(' '.join(COLUMNS)))} AS o), s AS (SELECT tip, w, list_filter(w, lambda x: list_contains({_LIST(advice.TECHNIQUE)}, x) OR len(list_filter(o, lambda c: contains(c, x) OR contains(x, c))) > 0) AS f FROM w, o), z AS (SELECT md5(tip) AS tip_md5, CASE WHEN len(w) > 0 THEN len(f)::DOUBLE / len(w) ELSE 0 END AS relevance FROM s) SELECT tip_md5, round(relevance, 6) AS relevance FROM z WHERE relevance >= 0.15")
def _(spark, d):
    made = advice.tip_relevance(read(spark, d, "benchmark").select(F.col("text").alias("tip")), COLUMNS)
    return made.select(F.md5(F.col("tip").cast("binary")).alias("tip_md5"), F.round("relevance", 6).alias("relevance"))


@query("jaccard", "WITH w AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda t: length(t) > 2)) AS w FROM conversations), z AS (SELECT conv_id, turn, w, lead(w) OVER (PARTITION BY conv_id ORDER BY turn) AS v FROM w) SELECT conv_id, turn, round(CASE WHEN len(w) = 0 OR len(v) = 0 THEN 0 ELSE len(list_intersect(w, v))::DOUBLE / len(list_distinct(list_concat(w, v))) END, 6) AS similarity FROM z WHERE v IS NOT NULL AND w IS NOT NULL")
def _(spark, d):
    from pyspark.sql import Window

    from ..functions import jaccard

    words = read(spark, d, "conversations").select("conv_id", "turn", text.token_set(F.col("text")).alias("w"))
    both = words.withColumn("v", F.lead("w").over(Window.partitionBy("conv_id").orderBy("turn"))).where("v IS NOT NULL AND w IS NOT NULL")
    return both.select("conv_id", "turn", F.round(jaccard(F.col("w"), F.col("v")), 6).alias("similarity"))


# --- notes: each conversation as a markdown note of its turns

TAGGED = lambda x: "array_to_string(list_sort(list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower({x}), '{w}')" for w in ws) + f" THEN '{t}' END" for t, ws in knowledge.TAGS.items()) + "], lambda t: t IS NOT NULL)), ',')"


@query("md_sections", "WITH n AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i FROM conversations WHERE text IS NOT NULL), s AS (SELECT conv_id, CAST(2 * i + 1 AS INTEGER) AS section, 'Turn ' || turn || ' — ' || role AS title, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS content FROM n) "
       f"SELECT conv_id, section, title, md5(content) AS content_md5, {TAGGED('(title || chr(10) || content)')} AS tags FROM s WHERE content <> ''")  # fmt: skip
def _(spark, d):
    turn = F.concat(F.lit("## Turn "), F.col("x.turn").cast("string"), F.lit("\n### "), F.col("x.role"), F.lit("\n"), F.col("x.text"))
    talks = read(spark, d, "conversations").where("text IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("xs"))
    notes = talks.select("conv_id", F.posexplode("xs").alias("i", "x")).select("conv_id", "i", turn.alias("part")).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "part"))), lambda p: p["part"]), "\n").alias("note"))
    made = knowledge.sections(notes, "conv_id", "note")
    return made.select("conv_id", "section", "title", F.md5(F.col("content").cast("binary")).alias("content_md5"), F.array_join("tags", ",").alias("tags"))


@query("infer_tags", f"SELECT doc_id, {TAGGED('text')} AS tags FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    return read(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.array_join(knowledge.tags(F.col("text")), ",").alias("tags"))


# --- text fields and keywords

TABLES = {"documents": ["text", "lang", "source"], "orders": ["o_orderstatus", "o_orderpriority"], "part": ["p_name", "p_brand", "p_type"], "conversations": ["role", "text"], "benchmark": ["text"], "events": ["event_type", "props"]}


@query("text_pick_column", " UNION ALL ".join(f"SELECT '{t}' AS \"table\", " + "CASE " + " ".join(f"WHEN avg(length(coalesce(CAST({c} AS VARCHAR), 'nan'))) > 30 THEN '{c}'" for c in cs) + f" END AS text_column FROM {t}" for t, cs in TABLES.items()))
def _(spark, d):
    return spark.createDataFrame([(t, textmodels.text_column(read(spark, d, t))) for t in TABLES], "table string, text_column string")


CLEAN_OF = lambda x: rf"trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query("text_coalesce", f"SELECT p_partkey, {CLEAN_OF('CASE WHEN p_partkey % 3 <> 0 THEN p_name WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_type END')} AS text FROM part")
def _(spark, d):
    blank = lambda c, keep: F.when(keep, F.col(c)).otherwise(F.when(F.col("p_partkey") % 5 == 0, "  ")).alias(c)
    df = read(spark, d, "part").select("p_partkey", blank("p_name", F.col("p_partkey") % 3 != 0), blank("p_brand", F.col("p_partkey") % 2 == 0), "p_type")
    return df.select("p_partkey", textmodels.text_of(df).alias("text"))


@query("keywords_for_class", f"WITH t AS (SELECT lang AS class, unnest({TOKENS}) AS term FROM documents), c AS (SELECT class, term, count(*) AS n FROM t WHERE class IS NOT NULL GROUP BY ALL), r AS (SELECT class, term, row_number() OVER (PARTITION BY class ORDER BY n DESC, term) AS rank FROM c), k AS (SELECT class, string_agg(term, ' ' ORDER BY rank) AS keywords FROM r WHERE rank <= 10 GROUP BY 1) SELECT doc_id, lang AS prediction, keywords FROM documents LEFT JOIN k ON lang = class")
def _(spark, d):
    docs = read(spark, d, "documents")
    counts = docs.where("lang IS NOT NULL").select(F.col("lang").alias("class"), F.explode(text.tokens(F.col("text"))).alias("term")).groupBy("class", "term").agg(F.count("*").alias("n"))
    top = text.top(counts.withColumn("score", F.col("n")), "class", "term", textmodels.KEYWORDS)
    made = textmodels.keywords_for(docs.select("doc_id", F.col("lang").alias("prediction")), top)
    return made.select("doc_id", "prediction", F.array_join("keywords", " ").alias("keywords"))


@query("drift_vocabulary", f"WITH t AS (SELECT doc_id % 2 AS side, unnest({TOKENS}) AS term FROM documents), c AS (SELECT term, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM t GROUP BY 1) SELECT round(sum(abs(a / (SELECT sum(a) FROM c) - b / (SELECT sum(b) FROM c))) / 2, 4) AS score FROM c")
def _(spark, d):
    docs = read(spark, d, "documents")
    made = reports.vocabulary_drift(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), "text")
    return made.select(F.round("score", 4).alias("score"))


@query("scatter_points", "SELECT l_quantity AS x, l_extendedprice AS y FROM (SELECT CASE WHEN l_orderkey % 10 <> 0 THEN l_quantity END AS l_quantity, l_extendedprice FROM lineitem) WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL")
def _(spark, d):
    from .tables import holes

    return reports.scatter(holes(spark, d), "l_quantity", "l_extendedprice")


# --- image labels: a path for each document

PATHS = {
    0: ("'train/' || source || '/' || lang || '_' || doc_id || '.jpg'", "source"),
    1: ("'n02099601-Shiba Inu/images/x' || doc_id || '.PNG'", "'shiba_inu'"),
    2: ("'data/' || doc_id || '/a.jpeg'", "CAST(doc_id AS VARCHAR)"),
    3: ("'pets/cat.' || doc_id || '.gif'", "'cat'"),
    4: ("'test/12/imgs/golden_retriever_' || doc_id || '.bmp'", "'golden_retriever'"),
    5: ("'__MACOSX/' || source || '/b.jpg'", None),
    6: ("'val/train_' || doc_id || '.webp'", "'train_' || doc_id"),
    7: ("source || '/notes.txt'", None),
}
PATH_SQL = "CASE doc_id % 8 " + " ".join(f"WHEN {k} THEN {p}" for k, (p, _) in PATHS.items()) + " END"
LABEL_SQL = "CASE doc_id % 8 " + " ".join(f"WHEN {k} THEN {x}" for k, (_, x) in PATHS.items() if x) + " END"


def paths(spark, d):
    return read(spark, d, "documents").where("source IS NOT NULL AND lang IS NOT NULL").select("doc_id", F.expr(PATH_SQL.replace("VARCHAR", "STRING")).alias("path"))


@query("path_labels", f"SELECT doc_id, {LABEL_SQL} AS label FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL AND doc_id % 8 NOT IN (5, 7)")
def _(spark, d):
    files = paths(spark, d)
    return files.where(images.is_image(F.col("path"))).select("doc_id", images.path_label(F.col("path")).alias("label"))


@query("image_layouts", f"WITH l AS (SELECT {LABEL_SQL} AS label, count(*) AS n FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL AND doc_id % 8 NOT IN (5, 7) GROUP BY 1) SELECT 'path' AS layout, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_classes, min(n) AS least, max(n) AS most, count(*) FILTER (regexp_full_match(label, '\\d+')) AS numeric, sum(n) >= 10 AND count(*) >= 2 AND NOT (max(n) = 1 AND (count(*) / sum(n) > 0.5 OR count(*) FILTER (regexp_full_match(label, '\\d+')) / count(*) > 0.7)) AS good FROM l")
def _(spark, d):
    return images.layouts(paths(spark, d), "path").where("layout = 'path'")
