"""Queries on labels, paths, answers of models and name choices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import coerce as C
from ..functions import text as T
from ..operators import markup, study_scores, taxonomy
from ..sources import records, sinks
from .registry import Tables, query
from .trees import NAMES, _names


@query(
    """WITH p AS (SELECT p_partkey AS k, p_name, p_partkey * p_partkey * 977 AS n, CAST(p_partkey * p_partkey * 977 AS DOUBLE) AS x FROM part)
    SELECT k, CASE WHEN k % 3 = 2 THEN 'Auto' ELSE 'Manual' END AS citation, CASE k % 4 WHEN 0 THEN 'increased' WHEN 1 THEN 'decreased' END AS direction, CASE k % 4 WHEN 0 THEN 12.0 WHEN 2 THEN 2.5 END::DOUBLE AS wait,
      CASE k % 3 WHEN 0 THEN 'a|' || p_name WHEN 1 THEN p_name ELSE '' END AS texts,
      CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', x / 1024) WHEN n < 1073741824 THEN printf('%.1f MB', x / 1048576) ELSE printf('%.1f GB', x / 1073741824) END AS size FROM p"""
)
def coerce_answers(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    pmid = F.when(k % 3 == 0, "NA").when(k % 3 == 1, " ").otherwise(k.cast("string"))
    said = F.when(k % 4 == 0, " Increased ").when(k % 4 == 1, "DECREASED").when(k % 4 == 2, "up")
    header = F.when(k % 4 == 0, "12").when(k % 4 == 1, "-3").when(k % 4 == 2, " 2.5 ").otherwise("Wed, 21 Oct")
    texts = C.text_list(F.when(k % 3 == 1, F.col("p_name")), F.when(k % 3 == 0, F.array(F.lit("a"), F.lit(" "), F.col("p_name"))))
    return t.part.select(
        k.alias("k"), C.citation_mode(pmid).alias("citation"), C.direction(said).alias("direction"), C.retry_after(header).alias("wait"), F.array_join(texts, "|").alias("texts"), C.human_size(k * k * 977).alias("size")
    )


@query(
    """SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN '3' WHEN 1 THEN '12' END AS figure, CASE c_custkey % 4 WHEN 0 THEN '3' WHEN 1 THEN '12' WHEN 2 THEN '7' ELSE '2' END AS number,
      CASE WHEN c_custkey % 2 = 0 THEN 'https://x/b/f' || c_custkey || '.jpg' ELSE 'https://x/a/f' || c_custkey || '.png' END AS found,
      'img/PMC' || c_custkey || '_F3' || CASE WHEN c_custkey % 2 = 0 THEN '.png' ELSE '.jpg' END AS path, 'https://h/r/a%20b%2Fc/x' || c_custkey AS raw,
      CASE c_custkey % 3 WHEN 0 THEN 'gmt' WHEN 1 THEN 'dump' END AS kind, CASE WHEN c_custkey % 2 = 0 THEN '/a/' || c_custkey END AS place FROM customer"""
)
def labels_and_paths(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    label = F.element_at(F.array(*map(F.lit, ("Figure 3A", " figure #12", "Table 7", "Fig 2"))), (k % 4 + 1).cast("int"))
    urls = F.array(F.concat(F.lit("https://x/a/f"), k, F.lit(".png")), F.concat(F.lit("https://x/b/f"), k, F.lit(".jpg")), F.lit("https://x/c/g.jpg"))
    name = F.concat(F.lit("f"), k, F.when(k % 2 == 0, ".jpg").otherwise(".tif"))
    ending = F.when(k % 2 == 0, ".png").otherwise("")
    file = F.when(k % 3 == 0, "x.gmt").when(k % 3 == 1, "full_dump.csv").otherwise("readme")
    message = F.when(k % 2 == 0, F.concat(F.lit("'x' is not valid in /a/"), k)).otherwise("nothing")
    return t.customer.select(
        k.alias("k"),
        T.figure_number(label).alias("figure"),
        T.first_number(label).alias("number"),
        T.match_file(name, urls).alias("found"),
        T.image_path(F.lit("img"), F.concat(F.lit("PMC"), k), F.lit("3"), ending).alias("path"),
        T.raw_address("https://h/r/", F.lit("a b/c"), F.concat(F.lit("x"), k)).alias("raw"),
        T.root_file_kind(file, ("full_dump.csv",)).alias("kind"),
        T.message_path(message).alias("place"),
    )


@query(
    """SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN 'Table ' || p_size WHEN p_partkey % 4 = 1 THEN p_brand ELSE 'id' || p_partkey END AS said,
      'T1' || chr(10) || CASE WHEN p_partkey % 2 = 0 THEN 'Ages' || chr(10) ELSE '' END || p_name || ' | x' || chr(10) || 'y' AS table_text, '## One' || chr(10) || p_name || chr(10) || chr(10) || 'bare' AS sections,
      p_partkey % 3 <> 2 AS signal, (2 * p_size) || '.0%' AS pct, '&lt;a &amp; b&gt;' || p_brand AS escaped, 'data:image/png;base64,' || to_base64(encode(p_name)) AS image,
      'title: ' || p_name || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '; note: n' END || '; source: ' || p_brand AS context FROM part"""
)
def report_texts(t: Tables) -> DataFrame:
    k, odd = F.col("p_partkey"), F.col("p_partkey") % 2 == 1
    rows = F.array(F.array(F.col("p_name"), F.lit("x")), F.array(F.lit("y")))
    section = lambda title, text: F.struct(F.lit(title).alias("title"), text.alias("text"))
    caption = F.when(k % 3 == 0, "LEfSe of taxa").when(k % 3 == 1, "significantly enriched in cases").otherwise("Ages")
    fields = {"title": F.col("p_name"), "note": F.when(odd, " n ").otherwise("NA")}
    return t.part.select(
        k.alias("k"),
        T.provenance("Table", F.when(~odd, F.col("p_size").cast("string")), F.when(k % 4 == 1, F.col("p_brand")).otherwise(""), F.concat(F.lit("id"), k)).alias("said"),
        T.table_text(F.lit("T1"), F.when(odd, "").otherwise("Ages"), rows).alias("table_text"),
        T.sections_text(F.array(section("One", F.col("p_name")), section("", F.lit("bare")), section("Empty", F.lit("")))).alias("sections"),
        T.differential_signal(caption).alias("signal"),
        T.percent(F.col("p_size") / 50).alias("pct"),
        T.escape_html(F.concat(F.lit("<a & b>"), "p_brand")).alias("escaped"),
        T.data_address(F.lit("image/png"), F.encode("p_name", "UTF-8")).alias("image"),
        T.source_context(fields, F.col("p_brand")).alias("context"),
    )


@query("SELECT '<tr><td>' || n_nationkey || '</td><td>' || n_name || ' &lt;' || n_regionkey || '&gt;</td></tr>' AS line FROM nation")
def html_lines(t: Tables) -> DataFrame:
    return sinks.html_rows(t.nation.select("n_nationkey", F.concat("n_name", F.lit(" <"), "n_regionkey", F.lit(">")).alias("cell")))


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 4 <> 3 THEN c_custkey END AS a, CASE WHEN c_custkey % 4 <> 3 THEN c_name END AS b, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS legend FROM customer")
def answers_and_figures(t: Tables) -> DataFrame:
    """Objects in bare, fenced, wrapped and missing answers, and the figure that a source label names."""
    k = F.col("c_custkey")
    said = F.to_json(F.struct(k.alias("a"), F.col("c_name").alias("b")))
    answer = F.when(k % 4 == 0, said).when(k % 4 == 1, F.concat(F.lit("Sure:\n```json\n"), said, F.lit("\n```\n"))).when(k % 4 == 2, F.concat(F.lit("It is "), said, F.lit(" as asked."))).otherwise("none")
    one = T.loose_json(answer, "a bigint, b string")
    figures = F.array(F.struct(F.lit("1").alias("number"), F.lit("x").alias("legend")), F.struct(F.lit("2").alias("number"), F.col("c_name").alias("legend")))
    figure = markup.figure_of(F.when(k % 2 == 0, "Figure 2B").otherwise("Figure 9"), figures)
    return t.customer.select(k.alias("k"), one["a"].alias("a"), one["b"].alias("b"), figure["legend"].alias("legend"))


@query(
    """SELECT CASE WHEN n_nationkey % 3 = 2 THEN 'file' || n_nationkey ELSE 'N' || n_nationkey END AS study_id, CASE WHEN n_nationkey % 3 = 0 THEN n_name || '|late' ELSE n_name END AS names FROM nation"""
)
def predictions_by_study(t: Tables) -> DataFrame:
    """Records by study_id, uid or file name; of several of one study the last file's."""
    k, n = F.col("n_nationkey"), F.col("n_name")
    ident = F.concat(F.lit("N"), k)
    line = F.when(k % 3 == 2, F.to_json(F.struct(n.alias("names")))).when(k % 3 == 1, F.to_json(F.struct(ident.alias("uid"), n.alias("names")))).otherwise(F.to_json(F.struct(ident.alias("study_id"), n.alias("names"))))
    files = t.nation.select(F.concat(F.lit("file"), k, F.lit(".json")).alias("file"), F.lit(0).alias("idx"), line.alias("record"), F.lit(None).cast("string").alias("error"))
    late = t.nation.where("n_nationkey % 3 = 0").select(F.lit("late.jsonl").alias("file"), k.cast("int").alias("idx"), F.to_json(F.struct(ident.alias("study_id"), F.array(n, F.lit("late")).alias("names"))).alias("record"), F.lit(None).cast("string").alias("error"))
    broken = t.nation.select(F.lit("z.json").alias("file"), F.lit(0).alias("idx"), F.lit(None).cast("string").alias("record"), F.lit("not JSON").alias("error"))
    return records.predictions(files.unionByName(late).unionByName(broken)).select("study_id", F.array_join(records.text_list(F.col("record"), "$.names"), "|").alias("names"))


@query(
    """WITH n AS (SELECT lower(p_name) AS name_norm, min(p_partkey) AS k FROM part GROUP BY 1)
    SELECT name_norm, CASE WHEN k % 5 = 0 THEN CASE WHEN k % 10 <> 0 THEN -k END WHEN k % 3 <> 0 THEN k END AS tax_id, CASE WHEN k % 4 IN (0, 2) THEN k END AS given, CASE WHEN k % 4 = 0 THEN k + 1 END AS choice FROM n"""
)
def names_with_cache(t: Tables) -> DataFrame:
    """Ids by a cache first and the store after; ids given as numbers or digits; choices among candidates."""
    n = t.part.groupBy(T.taxon_key(F.col("p_name")).alias("name_norm")).agg(F.min("p_partkey").alias("k"))
    k = F.col("k")
    cache = n.where("k % 5 = 0").select("name_norm", F.when(k % 10 != 0, -k).alias("tax_id"))
    store = n.where("k % 3 <> 0").select("name_norm", k.alias("tax_id"))
    known = taxonomy.with_cache(n.select("name_norm"), cache, store)
    value = F.when(k % 4 == 3, "true").when(k % 4 == 1, F.concat(F.lit("p"), k)).otherwise(k.cast("string"))
    kind = F.when(k % 4 == 3, "boolean").when(k % 4 == 0, "number").otherwise("string")
    choice = taxonomy.chosen(F.array(k, k + 1), F.when(k % 4 == 0, k + 1).otherwise(k + 5))
    return known.join(n.select("name_norm", taxonomy.taxon_id(value, kind).alias("given"), choice.alias("choice")), "name_norm")


@query(f"WITH {NAMES} SELECT tax_id, min(name_txt) AS name FROM names WHERE name_class = 'scientific name' GROUP BY 1")
def scientific_name(t: Tables) -> DataFrame:
    return taxonomy.scientific_names(_names(t))


@query(
    f"""WITH {NAMES}, best AS (SELECT lower(name_txt) AS k, coalesce(min(tax_id) FILTER (WHERE name_class = 'scientific name'), min(tax_id)) AS id FROM names GROUP BY 1),
    m AS (SELECT p_partkey AS old, min(p_partkey) OVER (PARTITION BY p_name, p_brand) AS new FROM part),
    said AS (SELECT l_orderkey, CASE WHEN l_linenumber = 4 THEN 'nobody' ELSE lower(p_name) END AS k, CASE WHEN l_linenumber % 2 = 1 THEN l_partkey END AS given FROM lineitem JOIN part ON p_partkey = l_partkey),
    f AS (SELECT l_orderkey, k, coalesce(given, id) AS id FROM said LEFT JOIN best USING (k)), c AS (SELECT l_orderkey, k, coalesce(new, id) AS id FROM f LEFT JOIN m ON id = old)
    SELECT l_orderkey, coalesce(array_to_string(list_sort(list(DISTINCT id) FILTER (WHERE id IS NOT NULL)), ','), '') AS ids, array_to_string(list_sort(list(DISTINCT split_part(k, ' ', 1))), ',') AS genera, count(*) FILTER (WHERE id IS NULL) AS n_unresolved FROM c GROUP BY 1"""
)
def predicted_taxa_ids(t: Tables) -> DataFrame:
    """Predicted taxa of each order as canonical ids, names standing in for missing ones."""
    first = t.part.groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("new_tax_id"))
    merged = t.part.join(first, ["p_name", "p_brand"]).where("p_partkey <> new_tax_id").select(F.col("p_partkey").alias("old_tax_id"), "new_tax_id")
    name = F.when(F.col("l_linenumber") == 4, "nobody").otherwise(F.concat(F.lit("g__"), "p_name"))
    said = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select("l_orderkey", name.alias("taxon_name"), F.when(F.col("l_linenumber") % 2 == 1, F.col("l_partkey").cast("string")).alias("ncbi_id"))
    taxa = said.groupBy(F.col("l_orderkey").alias("study_id")).agg(F.collect_list(F.struct("taxon_name", "ncbi_id")).alias("taxa"))
    signature = F.struct(F.lit(None).cast("string").alias("abundance_in_group_1"), "taxa")
    predicted = taxa.select("study_id", F.array(F.struct(F.array(signature).alias("signatures"))).alias("experiments"))
    found = study_scores.predicted_taxa(predicted, _names(t), merged).groupBy(F.col("study_id").alias("l_orderkey"))
    ids, genera = F.array_sort(F.collect_set("tax_id")), F.array_sort(F.collect_set(T.first_word(F.col("asked"))))
    return found.agg(F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("ids"), F.array_join(genera, ",").alias("genera"), F.count_if(F.col("tax_id").isNull()).alias("n_unresolved"))
