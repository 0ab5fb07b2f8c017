"""Array, embedding, JSON and one-hot operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright.catalog.registry import query, rounded, table, text_list
from loomwright.functions import arrays, jsoncols
from loomwright.operators import embed, features
from loomwright.operators.encode import MultiHot, OneHot
from loomwright.operators.lookup import mean_vectors

LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


@query("""
SELECT c_custkey, (c_mktsegment = 'BUILDING') AS "seg_BUILDING", (c_mktsegment = 'AUTOMOBILE') AS "seg_AUTOMOBILE",
       (c_mktsegment = 'FURNITURE') AS "seg_FURNITURE", (c_mktsegment = 'HOUSEHOLD') AS "seg_HOUSEHOLD",
       (c_mktsegment = 'MACHINERY') AS "seg_MACHINERY", coalesce(CASE WHEN c_nationkey > 3 THEN c_nationkey END = 4, FALSE) AS nation_4,
       c_mktsegment AS seg
FROM customer""")
def one_hot(spark, sf):
    rows = table(spark, sf, "customer").select(
        "c_custkey", F.col("c_mktsegment").alias("seg"), F.when(F.col("c_nationkey") > 3, F.col("c_nationkey")).alias("nation"))
    return OneHot(("seg", "nation"), {"nation": [4]}).fit_transform(rows).drop("nation")


@query("SELECT p_partkey, " + ", ".join(
    f"list_contains(string_split(p_name, ' '), '{w}') AS words_{w}" for w in ("red", "ring", "unheard")) + " FROM part")
def multi_hot_given_items(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.split("p_name", " ").alias("words"))
    return MultiHot(("words",), {"words": ["red", "ring", "unheard"]})(rows).drop("words")


@query("""
SELECT word AS flag, CAST(count(*) AS BIGINT) AS n FROM (SELECT 'words_' || unnest(list_distinct(string_split(p_name, ' '))) AS word FROM part)
GROUP BY 1""")
def multi_hot_counts(spark, sf):
    """How many rows carry each fitted flag."""
    rows = table(spark, sf, "part").select(F.split("p_name", " ").alias("words"))
    step = MultiHot(("words",)).fit(rows)
    flags = [f"words_{w}" for w in step.items["words"]]
    return step(rows).agg(*[F.count_if(f"`{f}`").alias(f) for f in flags]).unpivot([], flags, "flag", "n")


@query(f"""
SELECT {LINE}, array_to_string([l_quantity, l_discount * 100, l_tax * 100]::INTEGER[], '|') AS terms FROM lineitem""")
def packed_columns(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        *LINE_KEYS, F.col("l_quantity").alias("terms_0"), (F.col("l_discount") * 100).alias("terms_1"),
        (F.col("l_tax") * 100).alias("terms_2"))
    done = embed.Pack(("terms_0", "terms_1", "terms_2"), drop=True)(rows)
    whole = F.transform("terms", lambda x: F.round(x).cast("int"))
    return done.select(*LINE_KEYS, text_list(whole).alias("terms"))


@query("SELECT vec_id, " + ", ".join(
    f"round(embedding[{j + 1}]::DOUBLE, 6) + 0.0 AS embedding_clip_{j}" for j in range(64)) + " FROM embeddings")
def spread_vectors(spark, sf):
    done = embed.Spread(("embedding",), 64)(table(spark, sf, "embeddings"))
    return done.select("vec_id", *[rounded(f"embedding_clip_{j}").alias(f"embedding_clip_{j}") for j in range(64)])


@query("""
SELECT vec_id, round(embedding[1]::DOUBLE, 6) + 0.0 AS embedding,
       CASE WHEN label % 2 = 0 THEN 'even' END AS words FROM embeddings""")
def first_elements(spark, sf):
    words = F.when(F.col("label") % 2 == 0, F.array(F.lit("even"), F.lit("x"))).otherwise(F.array().cast("array<string>"))
    done = embed.First(("embedding", "words"))(table(spark, sf, "embeddings").withColumn("words", words))
    return done.select("vec_id", rounded("embedding").alias("embedding"), "words")


@query("""
WITH u AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)
SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(v / sqrt(sum(v * v) OVER (PARTITION BY vec_id)), 6) + 0.0 AS v FROM u""")
def unit_vectors(spark, sf):
    done = embed.Unit(("embedding",))(table(spark, sf, "embeddings"))
    return done.select("vec_id", F.posexplode("embedding").alias("pos", "v")).withColumn("v", rounded("v"))


@query("""
WITH u AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)
SELECT label, CAST(pos AS INTEGER) AS pos, round(avg(v), 6) + 0.0 AS v FROM u GROUP BY 1, 2""")
def mean_vector_by_label(spark, sf):
    done = mean_vectors(table(spark, sf, "embeddings"), ["label"], "embedding")
    return done.select("label", F.posexplode("embedding").alias("pos", "v")).withColumn("v", rounded("v"))


@query("""
WITH u AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
     r AS (SELECT vec_id, unnest(list_reverse(embedding))::DOUBLE AS w, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
     m AS (SELECT u.vec_id, u.pos, (v + CASE WHEN label % 2 = 0 THEN 0 ELSE w END) / 2 AS m FROM u JOIN r ON u.vec_id = r.vec_id AND u.pos = r.pos)
SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(m / sqrt(sum(m * m) OVER (PARTITION BY vec_id)), 6) + 0.0 AS v FROM m""")
def averaged_embeddings(spark, sf):
    rows = table(spark, sf, "embeddings").withColumn(
        "back_clip", F.when(F.col("label") % 2 == 1, F.reverse("embedding")))
    rows = rows.withColumnRenamed("embedding", "text_clip")
    done = embed.AverageVectors(("text_clip", "back_clip"), 64)(rows)
    return done.select("vec_id", F.posexplode("text_back__avg_clip").alias("pos", "v")).withColumn("v", rounded("v"))


@query("""
WITH f AS (SELECT source, arg_min(text, doc_id) AS t FROM documents GROUP BY source),
     e AS (SELECT source, length(t)::DOUBLE AS a, length(t) - length(replace(t, ' ', ''))::DOUBLE AS b,
                  length(t) - length(replace(t, 'e', ''))::DOUBLE AS c FROM f)
SELECT doc_id, round(a / sqrt(a * a + b * b + c * c), 6) AS chars, round(b / sqrt(a * a + b * b + c * c), 6) AS blanks,
       round(c / sqrt(a * a + b * b + c * c), 6) AS es
FROM documents JOIN e USING (source)""")
def encoded_once_per_source(spark, sf):
    def shape(text):
        total = F.length(text)
        return F.array(total, total - F.length(F.replace(text, F.lit(" "), F.lit(""))),
                       total - F.length(F.replace(text, F.lit("e"), F.lit(""))))

    step = embed.EncodeOnce(("text",), "source", ("doc_id",), embed.column_encoder(shape))
    done = step(table(spark, sf, "documents"))
    return done.select("doc_id", *[
        rounded(F.get("text_clip", F.lit(i))).alias(n) for i, n in enumerate(("chars", "blanks", "es"))])


@query("""
WITH f AS (SELECT source, arg_min(text, doc_id) AS t, arg_min(lang, doc_id) AS l FROM documents WHERE source IS NOT NULL GROUP BY 1)
SELECT doc_id, CAST(2 * length(t) AS DOUBLE) AS text_vector, CAST(2 * length(l) AS DOUBLE) AS lang_vector
FROM documents d LEFT JOIN f ON f.source = d.source""")
def encoded_columns_with_own_finish(spark, sf):
    """Two columns share one run of the encoder; a function of the caller finishes their vectors."""
    step = embed.EncodeOnce(("text", "lang"), "source", ("doc_id",), embed.column_encoder(lambda t: F.array(F.length(t))), normalize=False,
                            after=lambda v: F.transform(v, lambda x: 2 * x))
    done = step(table(spark, sf, "documents"))
    return done.select("doc_id", F.get("text_clip", F.lit(0)).alias("text_vector"), F.get("lang_clip", F.lit(0)).alias("lang_vector"))


@query("""
WITH f AS (SELECT source, arg_min(text, doc_id) AS t FROM documents WHERE source IS NOT NULL GROUP BY 1),
     w AS (SELECT source, unnest(string_split_regex(lower(t), '[[:space:]]+')) AS w FROM f)
SELECT doc_id, CAST(256 AS INTEGER) AS width, CAST(n AS DOUBLE) AS words
FROM documents LEFT JOIN (SELECT source, count(*) FILTER (w <> '') AS n FROM w GROUP BY 1) USING (source)""")
def token_counts_per_source(spark, sf):
    """Hashed counts of whole texts: whatever the cells, they add up to the number of words."""
    step = embed.EncodeOnce(("text",), "source", ("doc_id",), embed.token_counts(256), normalize=False)
    done = step(table(spark, sf, "documents"))
    return done.select("doc_id", F.size("text_clip").alias("width"), F.aggregate("text_clip", F.lit(0.0), lambda a, x: a + x).alias("words"))


@query("""
WITH lists AS (SELECT vec_id, text FROM (SELECT vec_id, label, unnest(['a b', 'label ' || label]) AS text FROM embeddings)),
     e AS (SELECT vec_id, avg(length(text)) AS a, avg(length(text) - length(replace(text, 'l', ''))) AS b FROM lists GROUP BY 1)
SELECT vec_id, round(a, 6) AS chars, round(b, 6) AS ls FROM e""")
def encoded_lists(spark, sf):
    """Lists of texts: every element is encoded, the list is averaged."""
    rows = table(spark, sf, "embeddings").select("vec_id", F.array(
        F.lit("a b"), F.concat(F.lit("label "), F.col("label").cast("string"))).alias("texts"))
    encoder = embed.column_encoder(lambda t: F.array(
        F.length(t), F.length(t) - F.length(F.replace(t, F.lit("l"), F.lit("")))))
    done = embed.EncodeOnce(("texts",), "vec_id", ("vec_id",), encoder, normalize=False)(rows)
    return done.select("vec_id", rounded(F.get("texts_clip", F.lit(0))).alias("chars"),
                       rounded(F.get("texts_clip", F.lit(1))).alias("ls"))


@query("""
WITH w AS (SELECT vec_id, embedding, unnest(range(0, 13)) AS win FROM embeddings)
SELECT vec_id, CAST(win AS INTEGER) AS win, round(list_sum(embedding[win * 4 + 1 : win * 4 + 16]::DOUBLE[]), 6) + 0.0 AS total,
       round(embedding[win * 4 + 1]::DOUBLE, 6) + 0.0 AS first FROM w""")
def sliding_windows(spark, sf):
    rows = table(spark, sf, "embeddings")
    cut = arrays.windows(F.col("embedding"), 64, 16, 4)
    long = rows.select("vec_id", F.posexplode(cut).alias("win", "w"))
    total = F.aggregate("w", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return long.select("vec_id", "win", rounded(total).alias("total"), rounded(F.get("w", F.lit(0))).alias("first"))


@query("""
WITH cells AS (SELECT br.b AS br, bc.b AS bc, r.i AS r, c.i AS c,
                      exp(-(pow(-1 + 2 * r.i / 3.0::DOUBLE, 2) + pow(-1 + 2 * c.i / 3.0::DOUBLE, 2)) / 2) / (2 * pi()) AS wt
               FROM range(0, 4) br(b), range(0, 4) bc(b), range(0, 4) r(i), range(0, 4) c(i)),
     taps AS (SELECT (br * 4 + r) * 16 + bc * 4 + c AS pos, ((br + bc) % 4) * 16 + r * 4 + c AS src, wt FROM cells)
SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(sum(embedding[src + 1]::DOUBLE * wt), 6) + 0.0 AS v
FROM embeddings, taps GROUP BY vec_id, pos""")
def overlap_grid(spark, sf):
    done = embed.OverlapGrid(("embedding",), 64, 16, 16, 0)(table(spark, sf, "embeddings"))
    return done.select("vec_id", F.posexplode("embedding_2d").alias("pos", "v")).withColumn("v", rounded("v"))


AGES = """
WITH r AS (SELECT p_partkey, [p_size, p_size + 20] AS lows, [p_size + 9, p_size + 60] AS highs, p_size % 5 = 0 AS nothing FROM part),
"""


def aged_parts(spark, sf):
    size = F.col("p_size")
    text = F.when(size % 5 == 0, F.lit('{"allow_unknown": false, "ages": null}')).otherwise(F.concat(
        F.lit('{"allow_unknown": true, "ages": [{"low": '), size.cast("string"), F.lit(', "high": '),
        (size + 9).cast("string"), F.lit('}, {"low": '), (size + 20).cast("string"), F.lit(', "high": '),
        (size + 60).cast("string"), F.lit("}]}")))
    rows = table(spark, sf, "part")
    return rows.select("p_partkey", F.when(size % 7 != 0, text).alias("age_targets"))


@query("""
SELECT p_partkey, p_size % 7 = 0 OR p_size % 5 <> 0 AS age_targets_allow_unknown,
       CASE WHEN p_size % 7 = 0 OR p_size % 5 = 0 THEN '' ELSE p_size || '|' || (p_size + 20) END AS age_targets_lows,
       CASE WHEN p_size % 7 = 0 OR p_size % 5 = 0 THEN '' ELSE (p_size + 9) || '|' || (p_size + 60) END AS age_targets_highs
FROM part""")
def age_targets(spark, sf):
    done = features.AgeTargets()(aged_parts(spark, sf))
    return done.select("p_partkey", "age_targets_allow_unknown", text_list("age_targets_lows").alias("age_targets_lows"),
                       text_list("age_targets_highs").alias("age_targets_highs"))


@query("""
WITH r AS (SELECT p_partkey, p_size AS s, p_size % 7 = 0 OR p_size % 5 = 0 AS nothing FROM part),
     ages AS (SELECT p_partkey, unnest(list_concat(range(s, s + 10), range(s + 20, s + 61))) AS a FROM r WHERE NOT nothing),
     bins AS (SELECT p_partkey, least(floor((a - 1) * 12 / 119.0::DOUBLE), 11) AS b, count(*) * 12 / 120.0::DOUBLE AS h FROM ages WHERE a BETWEEN 1 AND 120 GROUP BY 1, 2),
     grid AS (SELECT p_partkey, nothing, unnest(range(0, 12)) AS b FROM r),
     raw AS (SELECT g.p_partkey, g.b, CASE WHEN nothing THEN 1 ELSE coalesce(h, 0) END AS h
             FROM grid g LEFT JOIN bins USING (p_partkey, b)),
     norm AS (SELECT p_partkey, b, h / sqrt(sum(h * h) OVER (PARTITION BY p_partkey)) AS h FROM raw)
SELECT p_partkey, """ + ", ".join(f"round(sum(h) FILTER (b = {k}), 6) + 0.0 AS age_hist_{k}" for k in range(12)) + """
FROM norm GROUP BY p_partkey""")
def age_histogram(spark, sf):
    done = features.AgeHistogram()(features.AgeTargets()(aged_parts(spark, sf)))
    return done.select("p_partkey", *[rounded(f"age_hist_{k}").alias(f"age_hist_{k}") for k in range(12)])


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def flattened_json(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "props")
    return features.FlattenJson("props").fit_transform(rows)


@query("""
SELECT p_partkey, CAST(p_size AS BIGINT) AS "who.size", p_brand AS "who.brand", p_size > 25 AS large FROM part""")
def flattened_nested_json(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.to_json(F.struct(
        F.struct(F.col("p_size").alias("size"), F.col("p_brand").alias("brand")).alias("who"),
        (F.col("p_size") > 25).alias("large"))).alias("targets"))
    return features.FlattenJson("targets").fit_transform(rows)


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END AS "parts_0.a", CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END AS "parts_0.b",
       CASE WHEN o_orderkey % 3 = 2 THEN o_orderkey END AS "parts_1.a", CASE WHEN o_orderkey % 3 = 2 THEN 'x' END AS "parts_1.b"
FROM orders""")
def flattened_json_lists(spark, sf):
    first = F.struct(F.col("o_custkey").alias("a"), F.col("o_orderstatus").alias("b"))
    second = F.struct(F.col("o_orderkey").alias("a"), F.lit("x").alias("b"))
    kind = F.col("o_orderkey") % 3
    text = F.when(kind == 1, F.to_json(F.array(first))).when(kind == 2, F.to_json(F.array(first, second))).when(
        F.col("o_orderkey") % 2 == 0, F.lit(""))
    rows = table(spark, sf, "orders").select("o_orderkey", text.alias("parts"))
    return features.FlattenJson("parts", listed=True).fit_transform(rows)


@query("""
SELECT p_partkey, CAST(p_size AS BIGINT) AS "VOID_x", p_retailprice / 4 AS "OBJECT a, b<c", CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_size || '' END AS mixed,
       CAST(NULL AS VARCHAR) AS never, p_size || '|' || p_size + 1 AS "in.list" FROM part""")
def flattened_json_with_odd_names(spark, sf):
    """Names that look like types or hold their punctuation; fractions are doubles, mixed cells text."""
    size = F.col("p_size")
    mixed = F.when(size % 2 == 0, F.concat(F.lit('"'), F.col("p_brand"), F.lit('"'))).otherwise(size.cast("string"))
    text = F.concat(F.lit('{"VOID_x": '), size.cast("string"), F.lit(', "OBJECT a, b<c": '), (F.col("p_retailprice") / 4).cast("string"),
                    F.lit(', "mixed": '), mixed, F.lit(', "never": null, "in": {"list": ['), size.cast("string"), F.lit(", "),
                    (size + 1).cast("string"), F.lit("]}}"))
    done = features.FlattenJson("j").fit_transform(table(spark, sf, "part").select("p_partkey", text.alias("j")))
    return done.withColumn("in.list", text_list(F.col("`in.list`")))


@query("""
SELECT p_partkey, CAST(p_size AS BIGINT) AS size, p_name AS name, CAST(2 * p_size + 1 AS BIGINT) AS total, p_name || '|x' AS words FROM part""")
def decoded_json_cells(spark, sf):
    """Cells of objects become structs, lists of numbers stay numbers, quoted lists are texts."""
    size = F.col("p_size")
    rows = table(spark, sf, "part").select(
        "p_partkey", F.to_json(F.struct(size.alias("size"), F.col("p_name").alias("name"))).alias("who"),
        F.to_json(F.array(size, size + 1)).alias("numbers"), F.concat(F.lit("['"), F.col("p_name"), F.lit("', 'x']")).alias("words"))
    done = features.DecodeText().fit_transform(rows)
    return done.select("p_partkey", "who.size", "who.name", F.aggregate("numbers", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"),
                       text_list("words").alias("words"))


@query("""
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, user_id AS "list_0.u" FROM events""")
def flattened_many(spark, sf):
    rows = table(spark, sf, "events").select(
        "event_id", "props", F.to_json(F.array(F.struct(F.col("user_id").alias("u")))).alias("list"))
    return features.flatten_many(rows, ["props", "not_there"], ["list"])


@query("""
SELECT p_partkey, CASE WHEN p_size % 9 = 0 THEN '' ELSE p_name || '. ' || p_type END AS native_title,
       CASE WHEN p_size % 9 = 0 THEN '' ELSE p_brand END AS native_description, '' AS native_call_to_action FROM part""")
def typed_texts(spark, sf):
    rows = table(spark, sf, "part").select(
        "p_partkey", F.lit('["title", "description", "title"]').alias("native_text_types"),
        F.when(F.col("p_size") % 9 != 0, F.to_json(F.array("p_name", "p_brand", "p_type"))).alias("native_texts"))
    return features.TypedTexts()(rows).drop("native_text_types", "native_texts")


@query("""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_custkey || '|' || o_orderkey WHEN 1 THEN o_custkey || '|~' END AS "LIs" FROM orders""")
def line_item_ids(spark, sf):
    key = F.col("o_orderkey")
    cust = F.concat(F.lit('{"id": '), F.col("o_custkey").cast("string"), F.lit("}"))
    own = F.concat(F.lit('{"id": '), key.cast("string"), F.lit("}"))
    text = F.when(key % 4 == 0, F.concat(F.lit("["), cust, F.lit(", "), own, F.lit("]"))).when(
        key % 4 == 1, F.concat(F.lit("["), cust, F.lit(", null]"))).when(key % 4 == 2, F.lit("no json ["))
    done = features.LineItemIds()(table(spark, sf, "orders").select("o_orderkey", text.alias("line_items")))
    return done.select("o_orderkey", text_list("LIs").alias("LIs"))


@query("""
SELECT p_partkey, p_name || '|' || p_type AS decoded, p_name AS kept FROM part""")
def decoded_text_cells(spark, sf):
    name, kind = F.col("p_name"), F.col("p_type")
    quoted = F.concat(F.lit("['"), name, F.lit("', '"), kind, F.lit("']"))
    rows = table(spark, sf, "part").select("p_partkey", F.when(
        F.col("p_size") % 2 == 0, F.to_json(F.array(name, kind))).otherwise(quoted).alias("decoded"), name.alias("kept"))
    done = features.DecodeText().fit_transform(rows)
    return done.select("p_partkey", text_list("decoded").alias("decoded"), "kept")


@query("""
SELECT user_id || '' AS u, event_id, user_id || '|' || event_id AS numbers FROM events""")
def comma_lists(spark, sf):
    """Cells that are neither JSON nor quoted lists are split at commas."""
    rows = table(spark, sf, "events").select("event_id", F.col("user_id").cast("string").alias("u"), F.concat(
        F.lit("[["), F.col("user_id").cast("string"), F.lit(" , "), F.col("event_id").cast("string")).alias("text"))
    return rows.select("event_id", "u", text_list(jsoncols.string_list(F.col("text"))).alias("numbers"))


@query("SELECT p_partkey, p_name || '.mp4' AS files, (p_size + 1) || '|' || p_size AS numbers FROM part")
def parsed_json_lists(spark, sf):
    name, size = F.col("p_name"), F.col("p_size")
    rows = table(spark, sf, "part").select(
        "p_partkey", F.to_json(F.array(F.concat(name, F.lit(".mp4")), F.concat(name, F.lit("_1_2_756k.mp4")))).alias("files"),
        F.to_json(F.array(size + 1, size)).alias("numbers"))
    done = features.ParseLists(("numbers",), "bigint")(features.ParseLists(("files",))(rows))
    return done.select("p_partkey", text_list("files").alias("files"), text_list("numbers").alias("numbers"))


@query("""
SELECT role, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY role""")
def turns_by_role(spark, sf):
    from loomwright.operators.aggregate import GroupRows

    rows = table(spark, sf, "conversations").select("role", F.length("text").alias("chars"))
    return GroupRows(("role",), by_column={"chars": "sum"}, count_column="n")(rows).select(
        "role", "n", F.col("chars").cast("bigint").alias("chars"))
