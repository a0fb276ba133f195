"""Queries on the test tables, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billow.llm.bpe import decode_ids, encode_texts
from billow.llm.canon import canonical, counted_values, free_values
from billow.llm.leaks import leaks
from billow.llm.pairs import item_pairs
from billow.llm.setjoin import SimilarSets, expanded, record_links, similar_classes, token_sets
from billow.llm.spam import page_features, stuffed_pages
from billow.llm.terms import counted_pairs, field_sizes, marks, term_frequencies
from billow.llm.topn import top_n
from billow.tables import blank, fold, load, newest


def used_names(spark: SparkSession, folder: str) -> DataFrame:
    """name (folded) and repository_id of every artifact row that has a name."""
    return load(spark, folder, "artifacts").select(fold("name").alias("name"), "repository_id").filter("name IS NOT NULL AND repository_id IS NOT NULL")


def newest_topics(spark: SparkSession, folder: str) -> DataFrame:
    """repository_id and each element of the topics of its newest row, folded; repeated elements stay."""
    rows = newest(load(spark, folder, "repositories").select("id", "topics", "updated_at"), ["id"])
    return rows.select(F.col("id").alias("repository_id"), F.explode("topics").alias("topic")).select("repository_id", fold("topic").alias("topic")).filter("repository_id IS NOT NULL AND topic IS NOT NULL")


# 2: the best repositories of each package name


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    uses = used_names(spark, folder).distinct()
    stars = newest(load(spark, folder, "repositories").select("id", "stars", "updated_at"), ["id"]).select(F.col("id").alias("repository_id"), "stars")
    return top_n(uses.join(stars, "repository_id"), "name", "repository_id", "stars", 5).select("name", "rank", "repository_id")


# 3: terms and how often they occur


def terms(spark: SparkSession, folder: str) -> DataFrame:
    names = used_names(spark, folder).select(F.lit("names").alias("field"), F.col("name").alias("term"), F.col("repository_id").alias("record"))
    topics = newest_topics(spark, folder).select(F.lit("topics").alias("field"), F.col("topic").alias("term"), F.col("repository_id").alias("record"))
    return names.unionByName(topics)


def p3_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    counted = counted_pairs(terms(spark, folder), "field", "term", "record")
    return marks(term_frequencies(counted), field_sizes(counted))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_frequencies(spark, folder).filter("mark IS NOT NULL").select("field", "term", "mark")


# 4: licences typed freely


def typed_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """value: every licence of an artifact and every licence name of a repository, one row an occurrence."""
    elements = load(spark, folder, "artifacts").select(F.explode("licenses").alias("value"))
    return elements.unionByName(load(spark, folder, "repositories").select(F.col("license_name").alias("value"))).dropna()


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    entries = load(spark, folder, "license_list")
    counted = counted_values(typed_licenses(spark, folder), "value")
    free = free_values(counted, entries, "license_id", "full_name")
    return canonical(free, "value", entries, "license_id", "full_name", counted).select("raw_value", F.col("entry").alias("license_id"))


# 5: repositories with nearly the same sets


#: The fields, each with the terms that a set must have at the least.
FIELDS = {"topics": 5, "names": 8}


def similar_repositories(spark: SparkSession, folder: str) -> SimilarSets:
    """Classes and links of both fields in one plan: a record is (number of the field, id), a token (number, term), so
    sets of different fields never share one."""
    fields = [newest_topics(spark, folder).withColumnRenamed("topic", "term"), used_names(spark, folder).withColumnRenamed("name", "term")]
    each = [df.select(F.struct(F.lit(k).alias("f"), F.col("repository_id").alias("id")).alias("record"), F.struct(F.lit(k).alias("f"), "term").alias("token")) for k, df in enumerate(fields)]
    sets = token_sets(each[0].unionByName(each[1]), "record", "token")
    return similar_classes(sets.filter(F.size("tokens") >= F.when(F.col("record.f") == 0, FIELDS["topics"]).otherwise(FIELDS["names"])), (4, 5))


def field_of(record: str) -> F.Column:
    return F.when(F.col(f"{record}.f") == 0, "topics").otherwise("names").alias("field")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    found = expanded(similar_repositories(spark, folder))
    return found.select(field_of("record_a"), F.col("record_a.id").alias("repository_id_a"), F.col("record_b.id").alias("repository_id_b"))


def p5_class_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Similar pairs of different sets, each named by the least id that has it."""
    links = similar_repositories(spark, folder).links
    return links.select(field_of("rep_a"), F.col("rep_a.id").alias("class_a"), F.col("rep_b.id").alias("class_b"), F.col("shared").cast("bigint").alias("shared"), F.col("together").cast("bigint").alias("together"))


def p5_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Every repository with a set large enough: its class of equal sets, and how many repositories are similar to it."""
    found = record_links(similar_repositories(spark, folder))
    return found.select(field_of("record"), F.col("record.id").alias("repository_id"), F.col("rep.id").alias("class_id"), F.col("links").cast("bigint").alias("links"))


# 6: packages listed in the same SBOM


def p6_pairs(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "artifacts").filter((F.col("type") != "") & ~blank("sbom_commit_sha"))
    return item_pairs(rows.select("type", F.col("sbom_commit_sha").alias("sbom"), fold("name").alias("name")), "type", "sbom", "name")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_pairs(spark, folder).select("type", F.col("item_a").alias("name_a"), F.col("item_b").alias("name_b"))


# 7: token ids of every text


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_texts(load(spark, folder, "documents"), "doc_id", "text")


def p7_decoded(spark: SparkSession, folder: str) -> DataFrame:
    """The digest and the number of code points of what the ids decode to."""
    texts = decode_ids(p7_ids(spark, folder), "doc_id", "ids")
    return texts.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), F.length("text").cast("bigint").alias("n_chars"))


# 8: evaluation passages in documents


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with each item that it gives away: words of the longest run, and if question and answer are there."""
    documents, items = load(spark, folder, "documents"), load(spark, folder, "eval_items")
    return leaks(documents, "doc_id", "text", items, "item_id", "passage", "question", "answer").withColumn("words", F.col("words").cast("bigint"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_report(spark, folder).select("doc_id", "item_id")


# 9: pages of keywords and links


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return stuffed_pages(load(spark, folder, "documents"), "doc_id", "text", said="lang").select("doc_id")


def p9_features(spark: SparkSession, folder: str) -> DataFrame:
    return page_features(load(spark, folder, "documents"), "doc_id", "text", said="lang")


FOLD = "nullif(lower(trim({}, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))), '')"
USED = f"""n AS (SELECT {FOLD.format("name")} AS name, repository_id FROM artifacts),
 used AS (SELECT * FROM n WHERE name IS NOT NULL AND repository_id IS NOT NULL),
 last AS (SELECT * FROM repositories WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) = 1),
 t AS (SELECT id AS repository_id, unnest(topics) AS topic FROM last),
 topics AS (SELECT repository_id, {FOLD.format("topic")} AS topic FROM t WHERE {FOLD.format("topic")} IS NOT NULL)
"""
TERMS = f"""WITH {USED},
 p AS (SELECT 'names' AS field, name AS term, repository_id AS record FROM used UNION ALL SELECT 'topics', topic, repository_id FROM topics),
 f AS (SELECT field, term, count(*) AS occurrences, count(DISTINCT record) AS records FROM p GROUP BY field, term),
 s AS (SELECT field, count(DISTINCT record) AS total FROM p GROUP BY field),
 m AS (SELECT f.*, CASE WHEN records < 3 THEN 'rare' WHEN records * 100 > total * 20 THEN 'common' END AS mark FROM f JOIN s ON f.field = s.field)
"""
SIMILAR = f"""WITH {USED},
 s AS (SELECT DISTINCT 'topics' AS field, repository_id AS r, topic AS term FROM topics UNION ALL SELECT DISTINCT 'names', repository_id, name FROM used),
 z AS (SELECT field, r, count(*) AS n FROM s GROUP BY field, r HAVING n >= CASE field WHEN 'topics' THEN 5 ELSE 8 END),
 w AS (SELECT s.*, n FROM s JOIN z USING (field, r)),
 o AS (SELECT a.field, a.r AS ra, b.r AS rb, a.n AS na, b.n AS nb, count(*) AS k FROM w a JOIN w b ON a.field = b.field AND a.term = b.term AND a.r < b.r GROUP BY ALL)"""

QUERIES = {
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_frequencies": p3_frequencies,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_class_pairs": p5_class_pairs,
    "p5_classes": p5_classes,
    "p6_found": p6_found,
    "p6_pairs": p6_pairs,
    "p7_ids": p7_ids,
    "p7_decoded": p7_decoded,
    "p8_found": p8_found,
    "p8_report": p8_report,
    "p9_found": p9_found,
    "p9_features": p9_features,
}
PAIRS = f"""WITH r AS (SELECT DISTINCT type, sbom_commit_sha AS sbom, {FOLD.format("name")} AS name FROM artifacts
   WHERE type <> '' AND coalesce({FOLD.format("sbom_commit_sha")}, '') <> '' AND {FOLD.format("name")} IS NOT NULL),
 total AS (SELECT type, count(DISTINCT sbom) AS baskets FROM r GROUP BY type),
 single AS (SELECT type, name, count(*) AS n FROM r GROUP BY type, name),
 both_ AS (SELECT a.type, a.name AS item_a, b.name AS item_b, count(*) AS "both" FROM r a JOIN r b ON a.type = b.type AND a.sbom = b.sbom AND a.name < b.name
   GROUP BY a.type, a.name, b.name),
 pairs AS (SELECT p.type, item_a, item_b, x.n AS baskets_a, y.n AS baskets_b, "both", baskets, CAST("both" AS DOUBLE) * baskets / (x.n * y.n) AS lift
   FROM both_ p JOIN total USING (type) JOIN single x ON x.type = p.type AND x.name = item_a JOIN single y ON y.type = p.type AND y.name = item_b
   WHERE "both" >= 5 AND "both" * 100 >= 2 * baskets AND "both" * baskets >= 3 * x.n * y.n)
"""
RUNS = """WITH {name}_text AS (SELECT {key}, regexp_extract_all(lower(regexp_replace({text}, '[\\x{{AD}}\\x{{180E}}\\x{{200B}}-\\x{{200F}}\\x{{2060}}-\\x{{2064}}\\x{{FEFF}}]', '', 'g')), '[\\p{{L}}\\p{{N}}]+') AS w FROM {table}),
 {name} AS (SELECT DISTINCT {key}, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT {key}, w, unnest(range(1, len(w) - 10)) AS k FROM {name}_text WHERE len(w) >= 12))"""
PLAIN = "regexp_extract_all(lower(regexp_replace(coalesce({text}, ''), '[\\x{{AD}}\\x{{180E}}\\x{{200B}}-\\x{{200F}}\\x{{2060}}-\\x{{2064}}\\x{{FEFF}}]', '', 'g')), '[\\p{{L}}\\p{{N}}]+')"
SPACED = "' ' || array_to_string({words}, ' ') || ' '"
#: Runs of 12 words with their places; a run that goes on is a line of such places on one diagonal, 11 words longer than the line.
REPORT = f"""WITH d AS (SELECT doc_id, w, {SPACED.format(words="w")} AS joined FROM (SELECT doc_id, {PLAIN.format(text="text")} AS w FROM documents)),
 i AS (SELECT item_id, w, array_to_string(q, ' ') AS q, array_to_string(a, ' ') AS a FROM (SELECT item_id, {PLAIN.format(text="passage")} AS w, {PLAIN.format(text="question")} AS q, {PLAIN.format(text="answer")} AS a FROM eval_items)),
 dg AS (SELECT doc_id, k, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d WHERE len(w) >= 12)),
 ig AS (SELECT item_id, k, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i WHERE len(w) >= 12)),
 m AS (SELECT doc_id, item_id, dg.k AS x, dg.k - ig.k AS diagonal FROM dg JOIN ig ON dg.g = ig.g),
 l AS (SELECT doc_id, item_id, count(*) + 11 AS words FROM (SELECT *, x - row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY x) AS line FROM m) GROUP BY doc_id, item_id, diagonal, line)
 SELECT l.doc_id, l.item_id, max(words) AS words, any_value(i.q <> '' AND contains(d.joined, ' ' || i.q || ' ')) AS question, any_value(i.a <> '' AND contains(d.joined, ' ' || i.a || ' ')) AS answer
 FROM l JOIN d ON d.doc_id = l.doc_id JOIN i ON i.item_id = l.item_id GROUP BY l.doc_id, l.item_id"""
SQL = {
    "p8_report": REPORT,
    "p8_found": RUNS.format(name="d", key="doc_id", text="text", table="documents")
    + ", "
    + RUNS.format(name="i", key="item_id", text="passage", table="eval_items").removeprefix("WITH ")
    + " SELECT DISTINCT doc_id, item_id FROM d JOIN i ON d.g = i.g",
    "p2_found": f"""WITH {USED}, u AS (SELECT DISTINCT name, repository_id FROM used)
 SELECT name, row_number() OVER (PARTITION BY name ORDER BY stars DESC NULLS LAST, id) AS rank, repository_id
 FROM u JOIN last ON id = repository_id QUALIFY rank <= 5""",
    "p3_found": TERMS + "SELECT field, term, mark FROM m WHERE mark IS NOT NULL",
    "p3_frequencies": TERMS + "SELECT field, term, occurrences, records, mark FROM m",
    "p5_found": SIMILAR + " SELECT field, ra AS repository_id_a, rb AS repository_id_b FROM o WHERE k * 5 >= 4 * (na + nb - k)",
    "p5_class_pairs": SIMILAR + """, g AS (SELECT field, r, list_sort(list(term)) AS terms FROM w GROUP BY field, r), c AS (SELECT field, terms, min(r) AS r FROM g GROUP BY field, terms)
 SELECT o.field, ra AS class_a, rb AS class_b, k AS shared, na + nb - k AS together FROM o JOIN c x ON x.field = o.field AND x.r = ra JOIN c y ON y.field = o.field AND y.r = rb WHERE k * 5 >= 4 * (na + nb - k)""",
    "p5_classes": SIMILAR + """, g AS (SELECT field, r, list_sort(list(term)) AS terms FROM w GROUP BY field, r), c AS (SELECT *, min(r) OVER (PARTITION BY field, terms) AS class_id FROM g),
 e AS (SELECT field, ra AS r FROM o WHERE k * 5 >= 4 * (na + nb - k) UNION ALL SELECT field, rb FROM o WHERE k * 5 >= 4 * (na + nb - k)), h AS (SELECT field, r, count(*) AS links FROM e GROUP BY field, r)
 SELECT c.field, c.r AS repository_id, class_id, coalesce(links, 0) AS links FROM c LEFT JOIN h ON h.field = c.field AND h.r = c.r""",
    "p6_found": PAIRS + "SELECT type, item_a AS name_a, item_b AS name_b FROM pairs",
    "p6_pairs": PAIRS + "SELECT * FROM pairs",
    "p7_decoded": "SELECT doc_id, md5(coalesce(text, '')) AS digest, length(coalesce(text, '')) AS n_chars FROM documents",
}
