"""Queries on cells, strings and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import coerce as C
from ..functions import text as T
from ..operators import analytics, markup, normalize, schema
from ..operators.validation import Slot, validate
from ..sources import services
from .registry import Tables, query

DIRTY = "CASE CAST(c_custkey % 7 AS INT) WHEN 0 THEN 'NA' WHEN 1 THEN '' WHEN 2 THEN concat(' +', CAST(c_custkey AS STRING), ' ') WHEN 3 THEN concat(CAST(c_custkey AS STRING), '.5') WHEN 4 THEN concat(CAST(c_custkey AS STRING), '_000') WHEN 5 THEN concat(CAST(c_custkey AS STRING), 'd') ELSE concat('-', CAST(c_custkey AS STRING)) END"


@query(
    """WITH d AS (SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'NA' WHEN 1 THEN '' WHEN 2 THEN ' +' || c_custkey || ' ' WHEN 3 THEN c_custkey || '.5' WHEN 4 THEN c_custkey || '_000' WHEN 5 THEN c_custkey || 'd' ELSE '-' || c_custkey END AS cell FROM customer),
    s AS (SELECT *, trim(cell) AS v FROM d)
    SELECT c_custkey, (cell IS NULL OR v IN ('', 'NA')) AS blank,
      CASE WHEN regexp_matches(v, '^[+-]?[0-9]+(_[0-9]+)*$') THEN CAST(replace(v, '_', '') AS BIGINT) END AS as_int,
      CASE WHEN regexp_matches(v, '^[+-]?[0-9]+(_[0-9]+)*([.][0-9]*)?$') THEN CAST(replace(v, '_', '') AS DOUBLE) END AS as_float FROM s"""
)
def coerce_numeric(t: Tables) -> DataFrame:
    d = t.customer.select("c_custkey", F.expr(DIRTY).alias("cell"))
    cell = F.col("cell")
    return d.select("c_custkey", C.is_blank(cell).alias("blank"), C.to_int(cell).alias("as_int"), C.to_float(cell).alias("as_float"))


@query(
    """WITH d AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'no' WHEN 2 THEN 't' WHEN 3 THEN 'NA' ELSE 'Yes' END AS b,
      CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%-d %B %Y') WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%B %Y') ELSE 'NA' END AS s FROM orders)
    SELECT o_orderkey, CASE WHEN lower(b) IN ('true', 'yes') THEN true WHEN lower(b) IN ('false', 'no') THEN false END AS flag,
      CASE WHEN s <> 'NA' THEN coalesce(strftime(try_strptime(s, '%-d %B %Y'), '%Y-%m-%d'), s) END AS day FROM d"""
)
def coerce_bool_date(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    b = F.when(k % 5 == 0, "TRUE").when(k % 5 == 1, "no").when(k % 5 == 2, "t").when(k % 5 == 3, "NA").otherwise("Yes")
    s = F.when(k % 3 == 0, F.date_format("o_orderdate", "d MMMM yyyy")).when(k % 3 == 1, F.date_format("o_orderdate", "MMMM yyyy")).otherwise("NA")
    return t.orders.select("o_orderkey", C.to_bool(b).alias("flag"), C.to_date_text(s).alias("day"))


PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED")


@query(
    """SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED') THEN o_orderpriority END AS member,
      array_to_string(list_filter([CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED') THEN o_orderpriority END, '2-HIGH'], lambda x: x IS NOT NULL), '|') AS members FROM orders"""
)
def enum_normalize(t: Tables) -> DataFrame:
    mangled = F.when(F.col("o_orderkey") % 2 == 0, F.lower("o_orderpriority")).otherwise(F.concat(F.lit(" "), "o_orderpriority"))
    both = C.to_members(F.array(mangled, F.lit("2-high")), PRIORITIES)
    return t.orders.select("o_orderkey", C.to_member(mangled, PRIORITIES).alias("member"), F.array_join(both, "|").alias("members"))


@query(
    """WITH d AS (SELECT n_nationkey, CASE n_nationkey % 6 WHEN 0 THEN 'NA' WHEN 1 THEN 'na' WHEN 2 THEN 'NULL' WHEN 3 THEN '' WHEN 4 THEN NULL ELSE ' ' || n_name || ' ' END AS cell FROM nation)
    SELECT n_nationkey, CASE WHEN trim(cell) NOT IN ('', 'NA') THEN trim(cell) END AS nested_rule, CASE WHEN cell IS NULL OR upper(trim(cell)) IN ('', 'NA', 'NULL') THEN '' ELSE trim(cell) END AS split_rule FROM d"""
)
def blank_policies(t: Tables) -> DataFrame:
    k = F.col("n_nationkey") % 6
    cell = F.when(k == 0, "NA").when(k == 1, "na").when(k == 2, "NULL").when(k == 3, "").when(k == 4, F.lit(None)).otherwise(F.concat(F.lit(" "), "n_name", F.lit(" ")))
    return t.nation.select("n_nationkey", C.clean(cell).alias("nested_rule"), C.clean_text(cell).alias("split_rule"))


@query(
    """WITH d AS (SELECT p_partkey, 'Korea, Republic of,' || p_brand || ', x,,' || p_name AS cell FROM part)
    SELECT p_partkey, array_to_string(list_filter(list_transform(str_split(regexp_replace(cell, ',(\\s)', chr(1) || '\\1', 'g'), ','), lambda x: trim(replace(x, chr(1), ','))), lambda x: x <> ''), '|') AS strict_parts,
      array_to_string(list_filter(list_transform(str_split(cell, ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS loose_parts FROM d"""
)
def split_commas(t: Tables) -> DataFrame:
    cell = F.concat(F.lit("Korea, Republic of,"), "p_brand", F.lit(", x,,"), "p_name")
    return t.part.select("p_partkey", F.array_join(T.split_strict(cell), "|").alias("strict_parts"), F.array_join(T.split_loose(cell), "|").alias("loose_parts"))


@query(
    """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Doe A.B.|S' || c_custkey || ' C.' WHEN 1 THEN 'Doe|Jane|S' || c_custkey || '|X.' ELSE 'Consortium|S' || c_custkey || '|X.' END AS authors FROM customer"""
)
def split_authors(t: Tables) -> DataFrame:
    k, s = F.col("c_custkey") % 3, F.concat(F.lit("S"), "c_custkey")
    cell = F.when(k == 0, F.concat(F.lit("Doe, A.B. and "), s, F.lit(", C."))).when(k == 1, F.concat(F.lit("Doe, Jane, "), s, F.lit(", X."))).otherwise(F.concat(F.lit("Consortium, "), s, F.lit(", X.")))
    return t.customer.select("c_custkey", F.array_join(T.split_authors(cell), "|").alias("authors"))


@query("SELECT p_partkey, substr(CAST(p_size AS VARCHAR), 1, 1) AS low, CASE WHEN p_size > 9 THEN right(CAST(p_size AS VARCHAR), 1) END AS high FROM part")
def variable_region(t: Tables) -> DataFrame:
    low, high = C.region_bounds(F.col("p_size").cast("string"))
    return t.part.select("p_partkey", low.alias("low"), high.alias("high"))


@query("SELECT p_partkey, lower(p_name) AS name_norm, split_part(lower(p_name), ' ', 1) AS genus FROM part")
def taxon_norm(t: Tables) -> DataFrame:
    key = T.taxon_key(F.concat(F.lit(" g__"), F.replace("p_name", F.lit(" "), F.lit("__")), F.lit(" ")))
    return t.part.select("p_partkey", key.alias("name_norm"), T.first_word(key).alias("genus"))


@query(
    """WITH d AS (SELECT lang, CASE doc_id % 6 WHEN 0 THEN 'Figure 1A' WHEN 1 THEN 'Figs 2' WHEN 2 THEN 'Table S3' WHEN 3 THEN 'table 4' WHEN 4 THEN 'NA' ELSE 'Supplementary fig. 2' END AS s FROM documents)
    SELECT lang, CASE s WHEN 'Figure 1A' THEN 'figure' WHEN 'Table S3' THEN 'supplement' WHEN 'table 4' THEN 'main-table' WHEN 'Supplementary fig. 2' THEN 'supplement' ELSE 'other' END AS source_type, count(*) AS n FROM d GROUP BY ALL"""
)
def source_type(t: Tables) -> DataFrame:
    label = F.element_at(F.array(*map(F.lit, ("Figure 1A", "Figs 2", "Table S3", "table 4", "NA", "Supplementary fig. 2"))), (F.col("doc_id") % 6 + 1).cast("int"))
    return t.documents.groupBy("lang", T.source_type(label).alias("source_type")).agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN n <= 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 20 THEN '6-20' ELSE '21+' END AS bucket, count(*) AS customers, CAST(sum(n) AS BIGINT) AS orders FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) GROUP BY 1""")
def bucket_counts(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).groupBy(T.count_bucket(F.col("n")).alias("bucket")).agg(F.count("*").alias("customers"), F.sum("n").alias("orders"))


@query(
    """WITH c AS (SELECT l_orderkey, count(DISTINCT l_partkey) AS n, list_sort(list(DISTINCT l_partkey)) AS ids FROM lineitem GROUP BY 1)
    SELECT l_orderkey, n AS n_taxa, array_to_string(ids, ',') AS ids, CASE WHEN l_orderkey % 4 = 0 THEN '' ELSE array_to_string(list_transform(ids, lambda x: 'P' || x), ',') END AS names, CASE WHEN l_orderkey % 4 = 0 THEN 0 ELSE n END AS n_genus FROM c"""
)
def parse_taxa_pairs(t: Tables) -> DataFrame:
    ids = F.array_sort(F.collect_set("l_partkey"))
    cells = t.lineitem.groupBy("l_orderkey").agg(ids.alias("ids")).select(
        "l_orderkey",
        F.array_join(F.transform("ids", lambda x: F.concat(F.lit("2|"), x)), ";").alias("id_cell"),
        F.concat(F.array_join(F.transform("ids", lambda x: F.concat(F.lit("k__Bacteria|g__P"), x)), ","), F.when(F.col("l_orderkey") % 4 == 0, ",one too many").otherwise("")).alias("name_cell"),
    )
    taxa = cells.select("l_orderkey", normalize.parse_taxa(F.col("name_cell"), F.col("id_cell")).alias("t"))
    return taxa.select(
        "l_orderkey",
        F.size("t").cast("long").alias("n_taxa"),
        F.array_join(F.transform("t", lambda x: x["ncbi_id"].cast("string")), ",").alias("ids"),
        F.array_join(F.transform("t", lambda x: x["taxon_name"]), ",").alias("names"),
        F.size(F.filter("t", lambda x: x["rank"] == "genus")).cast("long").alias("n_genus"),
    )


@query(
    """SELECT page_id, array_to_string(list_filter(list_distinct_ordered, lambda x: true), '|') AS hrefs, len(list_distinct_ordered) AS n FROM
      (SELECT page_id, list_transform(list_filter(list_zip(a, range(1, len(a) + 1)), lambda z: list_position(a, z[1]) = z[2]), lambda z: z[1]) AS list_distinct_ordered FROM
        (SELECT page_id, regexp_extract_all(html, 'href="[^"]*"') AS a FROM pages))"""
)
def distinct_ordered(t: Tables) -> DataFrame:
    found = T.distinct_matches(F.col("html"), 'href="[^"]*"')
    return t.pages.select("page_id", F.array_join(found, "|").alias("hrefs"), F.size(found).cast("long").alias("n"))


@query(
    """SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<p>')) AS paragraphs, length(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) AS n_chars FROM pages"""
)
def html_outline(t: Tables) -> DataFrame:
    html = F.col("html")
    text = F.btrim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"[ \t\n\r\f\x0b]+", " "))
    return t.pages.select("page_id", F.regexp_extract(html, "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count(html, F.lit("<p>")).cast("long").alias("paragraphs"), F.length(text).cast("long").alias("n_chars"))


@query("SELECT event_type, count(*) AS n, count(json_extract_string(props, '$.k')) AS with_k, CAST(sum(try_cast(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k FROM events GROUP BY 1")
def json_props(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.count(k).alias("with_k"), F.sum(k.try_cast("bigint")).alias("sum_k"))


def _articles(t: Tables) -> DataFrame:
    """An article for each customer, as XML."""
    c, n = F.col("c_custkey").cast("string"), F.col("c_name")
    fig = F.concat(F.lit("<fig><label>Figure "), c, F.lit("</label><caption><p>LEfSe of "), n, F.lit('</p></caption><graphic xlink:href="f'), c, F.lit('"/></fig>'))
    table = F.concat(F.lit("<table-wrap><label>Table "), c, F.lit("</label><caption><p>Ages</p></caption><table><tr><th>a</th><td>"), n, F.lit("</td></tr></table></table-wrap>"))
    front = F.concat(F.lit("<front><journal-title>"), F.col("c_mktsegment"), F.lit('</journal-title><article-id pub-id-type="doi">10.1/'), c, F.lit("</article-id><article-title>On "), n, F.lit("</article-title><pub-date><year>20"), F.lpad((F.col("c_nationkey")).cast("string"), 2, "0"), F.lit("</year></pub-date></front>"))
    xml = F.concat(F.lit('<article xmlns:xlink="http://www.w3.org/1999/xlink">'), front, F.lit("<body><sec><title>One</title><p>Text  of "), n, F.lit("</p></sec>"), fig, table, F.lit("</body></article>"))
    return t.customer.select("c_custkey", F.when(F.col("c_custkey") % 10 == 0, "<broken").otherwise(xml).alias("xml"))


@query(
    """SELECT c_custkey, c_custkey % 10 = 0 AS broken, CASE WHEN c_custkey % 10 <> 0 THEN 'On ' || c_name END AS title, CASE WHEN c_custkey % 10 <> 0 THEN c_mktsegment END AS journal, CASE WHEN c_custkey % 10 <> 0 THEN 2000 + c_nationkey END AS year, CASE WHEN c_custkey % 10 <> 0 THEN '10.1/' || c_custkey END AS doi,
      CASE WHEN c_custkey % 10 <> 0 THEN 'Figure ' || c_custkey || ':' || c_custkey || ':LEfSe of ' || c_name || ':f' || c_custkey ELSE '' END AS figures, CASE WHEN c_custkey % 10 <> 0 THEN 'One:Text of ' || c_name ELSE '' END AS sections, CASE WHEN c_custkey % 10 <> 0 THEN 'a:' || c_name ELSE '' END AS cells FROM customer"""
)
def article_parts(t: Tables) -> DataFrame:
    a = markup.parse_articles(_articles(t), "c_custkey")
    joined = lambda column, *names: F.array_join(F.transform(column, lambda x: F.concat_ws(":", *[x[n] for n in names])), ",")
    cells = F.array_join(F.transform("tables", lambda x: F.array_join(F.flatten(x["rows"]), ":")), ",")
    return a.select("c_custkey", F.col("parse_error").isNotNull().alias("broken"), "meta.title", "meta.journal", F.col("meta.year").cast("long").alias("year"), "meta.doi", joined("figures", "label", "number", "legend", "graphic_filename").alias("figures"), joined("sections", "title", "text").alias("sections"), cells.alias("cells"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 <> 0 THEN 'f' || c_custkey END AS image, CASE WHEN c_custkey % 10 <> 0 THEN 'Figure ' || c_custkey END AS artifact FROM customer")
def article_evidence(t: Tables) -> DataFrame:
    """The image address of each figure from the article's page, and the artifact to read."""
    pages = t.customer.select("c_custkey", F.concat(F.lit('<img src="https://cdn.example/blobs/a/f'), "c_custkey", F.lit('.jpg">')).alias("html"))
    found = markup.evidence(markup.parse_articles(_articles(t), "c_custkey"), pages, "c_custkey")
    image = F.regexp_extract(F.get("figures", F.lit(0))["image_url"], "/(f[0-9]+)[.]jpg$", 1)
    return found.select("c_custkey", image.alias("image"), markup.located(F.col("tables"), F.col("figures"))["said"].alias("artifact"))


@query("SELECT c_custkey AS pmid, CASE WHEN c_custkey % 3 <> 0 THEN 'PMC' || c_custkey END AS pmcid, '10.1/' || c_custkey AS doi FROM customer")
def id_conversions(t: Tables) -> DataFrame:
    """Answers of a conversion service, one for each nation."""
    c = F.col("c_custkey").cast("string")
    record = F.struct(c.alias("pmid"), F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("PMC"), c)).alias("pmcid"), F.concat(F.lit("10.1/"), c).alias("doi"))
    answers = t.customer.groupBy("c_nationkey").agg(F.to_json(F.struct(F.lit("ok").alias("status"), F.collect_list(record).alias("records"))).alias("json"))
    return services.conversions(answers).withColumn("pmid", F.col("pmid").cast("long"))


@query("SELECT c_nationkey, count(*) AS n, count(*) FILTER (WHERE c_custkey % 4 <> 0) AS licensed FROM customer GROUP BY 1")
def licenses(t: Tables) -> DataFrame:
    xml = F.when(F.col("c_custkey") % 4 == 0, '<OA><error code="x">no</error></OA>').otherwise('<OA><records><record license="CC BY"/></records></OA>')
    return t.customer.select("c_nationkey", services.full_text_license(xml).alias("l")).groupBy("c_nationkey").agg(F.count("*").alias("n"), F.count("l").alias("licensed"))


@query("SELECT 'x' || n_nationkey || CASE WHEN n_regionkey = 0 THEN '.gmt' ELSE '.csv' END AS path, n_nationkey AS size FROM nation WHERE n_regionkey = 0 AND n_nationkey <> 5")
def listing_to_download(t: Tables) -> DataFrame:
    """Root files of a known kind that are not there yet in the same size."""
    ending = F.when(F.col("n_regionkey") == 0, ".gmt").otherwise(".csv")
    entry = F.struct(F.concat(F.when(F.col("n_regionkey") == 1, "folder/").otherwise("x"), "n_nationkey", ending).alias("path"), F.lit("blob").alias("type"), F.col("n_nationkey").alias("size"))
    answer = t.nation.agg(F.to_json(F.struct(F.collect_list(entry).alias("tree"))).alias("json"))
    files = services.of_kind(services.listed_files(answer, ("full_dump.csv",)), "gmt")
    present = t.nation.where("n_nationkey = 5").select(F.lit("x5.gmt").alias("path"), F.col("n_nationkey").cast("bigint").alias("size"))
    return services.to_download(files, present).select("path", "size")


RECORD = {"uid": Slot(required=True), "pmid": Slot("integer"), "state": Slot(("Complete", "Incomplete")), "tags": Slot(("a", "b"), many=True)}


@query(
    """SELECT c_custkey, CASE c_custkey % 5 WHEN 1 THEN '/' WHEN 2 THEN '/pmid' WHEN 3 THEN '/state' WHEN 4 THEN '/' ELSE '' END AS paths, c_custkey % 5 = 0 AS valid FROM customer"""
)
def validation_problems(t: Tables) -> DataFrame:
    k = F.col("c_custkey") % 5
    record = F.to_json(
        F.struct(
            F.when(k != 1, F.col("c_name")).alias("uid"),
            F.when(k == 2, "x").alias("pmid"),
            F.when(k == 3, "complete").otherwise("Complete").alias("state"),
            F.when(k == 4, 1).alias("extra"),
            F.array(F.lit("a"), F.lit("b")).alias("tags"),
        )
    )
    checked = validate(t.customer.select("c_custkey", record.alias("record")), RECORD)
    return checked.select("c_custkey", F.array_join(F.transform("problems", lambda p: p["path"]), ",").alias("paths"), "valid")


#: A study of trials of sets of members.
NESTED = schema.parse(
    {
        "classes": {
            "Page": {"mixin": True, "slots": ["state"]},
            "Study": {"mixins": ["Page"], "slots": ["name", "trials"]},
            "Trial": {"slots": ["host", "sets"]},
            "Set": {"slots": ["direction", "members"]},
            "Member": {"attributes": {"number": {"range": "integer", "required": True}}},
        },
        "slots": {"state": {"range": "State"}, "name": {"required": True}, "trials": {"range": "Trial", "multivalued": True}, "host": None, "sets": {"range": "Set", "multivalued": True}, "direction": {"range": "Direction"}, "members": {"range": "Member", "multivalued": True}},
        "enums": {"State": {"permissible_values": {"O": None, "P": None}}, "Direction": {"permissible_values": {"up": None, "down": None}}},
    }
)


@query(
    """WITH f AS (SELECT o_orderkey, '/' AS path, 'Study' AS class FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT o_orderkey, '/state', 'Study' FROM orders WHERE o_orderstatus = 'F'
      UNION ALL SELECT l_orderkey, '/trials/#', 'Trial' FROM lineitem WHERE l_quantity > 45 UNION ALL SELECT l_orderkey, '/trials/#/sets/#/direction', 'Set' FROM lineitem WHERE l_discount > 0.09
      UNION ALL SELECT l_orderkey, '/trials/#/sets/#/members/#', 'Member' FROM lineitem WHERE l_linenumber = 2 UNION ALL SELECT l_orderkey, '/trials/#/sets/#/members/#/number', 'Member' FROM lineitem WHERE l_tax > 0.07 AND l_linenumber <> 2)
    SELECT o_orderkey, path, class, count(*) AS n FROM f JOIN orders USING (o_orderkey) GROUP BY ALL"""
)
def nested_validation(t: Tables) -> DataFrame:
    """Faults at every depth of an order's record, by path."""
    number = F.when(F.col("l_linenumber") != 2, F.when(F.col("l_tax") > 0.07, F.concat(F.lit("no "), "l_partkey")).otherwise(F.col("l_partkey").cast("string")))
    member = F.struct(number.alias("number"))
    one = F.struct(F.when(F.col("l_discount") > 0.09, "sideways").otherwise("up").alias("direction"), F.array(member).alias("members"))
    trial = F.struct(F.col("l_returnflag").alias("host"), F.array(one).alias("sets"), F.when(F.col("l_quantity") > 45, 1).alias("odd"))
    trials = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(trial).alias("trials"))
    whole = F.to_json(F.struct(F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderkey").cast("string")).alias("name"), F.col("o_orderstatus").alias("state"), "trials"))
    # Digits alone become a number; what is not alone stays a text.
    record = F.regexp_replace(whole, '"number":"([0-9]+)"', '"number":$1')
    found = schema.validate(t.orders.join(trials, "o_orderkey", "left").select("o_orderkey", record.alias("record")), NESTED, "Study")
    # An inner explode would have the optimizer ask twice more, in a filter, whether there are any problems: each time they are all found anew.
    each = found.select("o_orderkey", F.explode_outer("problems").alias("p")).where("p is not null").select("o_orderkey", F.regexp_replace("p.path", "/[0-9]+", "/#").alias("path"), F.col("p.instantiates").alias("class"))
    return each.groupBy("o_orderkey", "path", "class").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'http://x/obo/efo_' || p_size END AS address, CASE WHEN p_size < 10 THEN 'EFO:' || p_size END AS term FROM part")
def ontology_ids(t: Tables) -> DataFrame:
    address = F.when(F.col("p_size") < 10, F.concat(F.lit("http://x/obo/efo_"), "p_size"))
    return t.part.select("p_partkey", address.alias("address"), T.ontology_id(address).alias("term"))


@query("SELECT p_partkey, CAST(unnest(generate_series(CAST(p_size // 10 AS BIGINT), CAST(p_size // 10 + p_size % 10 AS BIGINT))) AS BIGINT) AS region FROM part")
def region_expand(t: Tables) -> DataFrame:
    low = F.floor(F.col("p_size") / 10).cast("long")
    return analytics.regions(t.part.select("p_partkey", low.alias("low"), (low + F.col("p_size") % 10).alias("high"))).select("p_partkey", F.col("region").cast("long").alias("region"))
