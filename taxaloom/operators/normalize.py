"""The dump as relational tables, and as nested records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coerce as C
from ..functions import text as T
from ..functions import vocabulary as V
from ..sources.dump import ORDER

# Column of the table, column of the dump.
STUDY = {
    "pmid": "PMID", "doi": "DOI", "url": "URL", "authors": "Authors list", "title": "Title", "journal": "Journal", "year": "Year", "keywords": "Keywords", "study_design": "Study design",
    "curator": "Curator", "curated_date": "Curated date", "revision_editor": "Revision editor", "state": "State", "reviewer": "Reviewer",
}
EXPERIMENT = {
    "location_of_subjects": "Location of subjects", "host_species": "Host species", "body_site": "Body site", "uberon_id": "UBERON ID", "condition": "Condition", "efo_id": "EFO ID",
    "group_0_name": "Group 0 name", "group_1_name": "Group 1 name", "group_1_definition": "Group 1 definition", "group_0_sample_size": "Group 0 sample size",
    "group_1_sample_size": "Group 1 sample size", "antibiotics_exclusion": "Antibiotics exclusion", "sequencing_type": "Sequencing type", "variable_region": "16S variable region",
    "sequencing_platform": "Sequencing platform", "data_transformation": "Data transformation", "statistical_test": "Statistical test", "significance_threshold": "Significance threshold",
    "mht_correction": "MHT correction", "lda_score_above": "LDA Score above", "matched_on": "Matched on", "confounders_controlled_for": "Confounders controlled for", "pielou": "Pielou",
    "shannon": "Shannon", "chao1": "Chao1", "simpson": "Simpson", "inverse_simpson": "Inverse Simpson", "richness": "Richness",
}
SIGNATURE = {
    "signature_name": "Signature page name", "source": "Source", "description": "Description", "abundance_in_group_1": "Abundance in Group 1", "curation_state": "State", "curator": "Curator",
    "curated_date": "Curated date", "revision_editor": "Revision editor", "reviewer": "Reviewer",
}


def first_wins(rows: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """One row per key: the first in order, and its place."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("__r"), F.min(order).alias(order)).select(key, "__r.*", order)


def last_wins(rows: DataFrame, key: str, order: Column, columns: list[str]) -> DataFrame:
    """One row per key: the last in order; its place is the key's first."""
    kept = rows.withColumn("__o", order)
    return kept.groupBy(key).agg(F.max_by(F.struct(*columns), "__o").alias("__r"), F.min("__o").alias("__first")).select(key, "__r.*", "__first")


def _cell(column: str) -> Column:
    return C.clean_text(F.col(f"`{column}`"))


def split_dump(dump: DataFrame) -> dict[str, DataFrame]:
    """studies, experiments, signatures, taxa and signatures_taxa, all of strings, blanks empty.

    The first row of a study, experiment or signature holds; the last name of a taxon
    does, an empty one included; links stay as often as they come.
    """
    rows = dump.select(ORDER, _cell("Study").alias("study_id"), _cell("Experiment").alias("experiment_name"), _cell("BSDB ID").alias("signature_id"), "*").where("study_id <> ''")
    pick = lambda names: [_cell(c).alias(k) for k, c in names.items()]
    studies = first_wins(rows.select(F.col(ORDER), "study_id", *pick(STUDY)), "study_id", ORDER, list(STUDY))
    with_experiment = rows.where("experiment_name <> ''").withColumn("experiment_id", F.concat_ws("/", "study_id", "experiment_name"))
    experiments = first_wins(with_experiment.select(F.col(ORDER), "experiment_id", "study_id", "experiment_name", *pick(EXPERIMENT)), "experiment_id", ORDER, ["study_id", "experiment_name", *EXPERIMENT])
    with_signature = with_experiment.where("signature_id <> ''")
    signatures = first_wins(with_signature.select(F.col(ORDER), "signature_id", "experiment_id", *pick(SIGNATURE)), "signature_id", ORDER, ["experiment_id", *SIGNATURE])
    segments = _segments(with_signature)
    taxa = last_wins(segments.where("ncbi_id <> ''"), "ncbi_id", F.struct(ORDER, "taxon", "segment"), ["taxon_name"]).drop("__first")
    leaves = _paired(with_signature).select("signature_id", _last_id(F.col("x.i")).alias("ncbi_id")).where("ncbi_id is not null")
    return {"studies": studies.drop(ORDER), "experiments": experiments.drop(ORDER), "signatures": signatures.drop(ORDER), "taxa": taxa, "signatures_taxa": leaves}


def _paired(rows: DataFrame) -> DataFrame:
    """A row for each taxon of a signature: x.n and x.i, the lineage's names and ids; they pair by place, the shorter list padded."""
    names, ids = F.split(_cell("MetaPhlAn taxon names"), ","), F.split(_cell("NCBI Taxonomy IDs"), ";")
    return rows.select(ORDER, "signature_id", F.posexplode(F.arrays_zip(names.alias("n"), ids.alias("i"))).alias("taxon", "x"))


def _last_id(ids: Column) -> Column:
    """The last of a lineage's ids that is not empty, or null."""
    return F.try_element_at(F.filter(F.transform(F.split(ids, r"\|"), C.strip), lambda i: i != ""), F.lit(-1))


def _segments(rows: DataFrame) -> DataFrame:
    """A row for each segment of each taxon's lineage; names and ids pair by place, the shorter list padded."""
    parts = _paired(rows).select(ORDER, "signature_id", "taxon", F.posexplode(F.arrays_zip(F.split("x.n", r"\|").alias("n"), F.split("x.i", r"\|").alias("i"))).alias("segment", "y"))
    return parts.select(ORDER, "signature_id", "taxon", "segment", C.strip(F.coalesce("y.i", F.lit(""))).alias("ncbi_id"), C.strip(F.coalesce("y.n", F.lit(""))).alias("taxon_name"))


def parse_taxon(names: Column, ids: Column) -> Column:
    """A taxon of a lineage's names and ids, both parted by bars; null without an id.

    The id and name are the last ones, the rank is that of the name's prefix, and the
    lineage by rank is kept where the name has more than one segment.
    """
    parts = lambda v: F.filter(F.transform(F.split(F.coalesce(v, F.lit("")), r"\|"), C.strip), lambda x: x != "")
    ranks = F.create_map(*[F.lit(x) for kv in V.RANKS.items() for x in kv])

    def segment(x: Column) -> Column:
        """A name's rank and what stands behind the prefix that tells it; one without a prefix as it is."""
        told = x.rlike("^[a-zA-Z]__.+$")
        return F.struct(F.when(told, F.try_element_at(ranks, F.lower(F.left(x, F.lit(1))))).alias("k"), F.when(told, F.substr(x, F.lit(4))).otherwise(x).alias("v"))

    def made(n: Column, leaf: Column) -> Column:
        last = F.try_element_at(n, F.lit(-1))
        lineage = F.map_from_entries(F.filter(n, lambda e: e["k"].isNotNull()))
        return F.struct(leaf.alias("ncbi_id"), last["v"].alias("taxon_name"), last["k"].alias("rank"), F.when(F.size(n) > 1, F.to_json(lineage)).alias("lineage"))

    leaf = C.to_int(F.try_element_at(parts(ids), F.lit(-1)))
    # Both sides are worked out once, and the names only where there is an id.
    return C.let(leaf, lambda k: F.when(k.isNotNull(), C.let(F.transform(parts(names), segment), lambda n: made(n, k))))


def parse_taxa(names: Column, ids: Column) -> Column:
    """The taxa of a signature's cells; if the lists differ in length, no names are trusted."""
    n = F.when(C.is_blank(names), F.array().cast("array<string>")).otherwise(F.split(names, ","))
    i = F.when(C.is_blank(ids), F.array().cast("array<string>")).otherwise(F.split(ids, ";"))
    paired = F.when(F.size(n) == F.size(i), n).otherwise(F.transform(i, lambda x: F.lit(None).cast("string")))
    return F.filter(F.zip_with(paired, i, parse_taxon), lambda t: t.isNotNull())


def _c(column: str) -> Column:
    return F.col(f"`{column}`")


#: The dump's columns that study_fields() reads.
STUDY_CELLS = ("PMID", "DOI", "URL", "Title", "Journal", "Year", "Authors list", "Keywords", "Study design")


def study_fields() -> list[Column]:
    return [
        C.to_int(_c("PMID")).alias("pmid"),
        C.citation_mode(_c("PMID")).alias("citation_mode"),
        *[C.clean(_c(c)).alias(k) for k, c in (("doi", "DOI"), ("uri", "URL"), ("title", "Title"), ("journal", "Journal"))],
        C.to_int(_c("Year")).alias("year"),
        C.none_if_empty(T.split_authors(_c("Authors list"))).alias("authors"),
        C.none_if_empty(T.split_loose(_c("Keywords"))).alias("keywords"),
        C.none_if_empty(C.to_members(T.split_strict(_c("Study design")), V.STUDY_DESIGN)).alias("study_design"),
    ]


def experiment_fields() -> list[Column]:
    lists = ("location_of_subjects", "body_site", "condition", "matched_on", "confounders_controlled_for")
    plain = ("host_species", "group_0_name", "group_1_name", "group_1_definition", "antibiotics_exclusion")
    low, high = C.region_bounds(_c("16S variable region"))
    return [
        *[C.none_if_empty(T.split_strict(_c(EXPERIMENT[k]))).alias(k) for k in lists],
        *[C.clean(_c(EXPERIMENT[k])).alias(k) for k in plain],
        *[C.to_int(_c(EXPERIMENT[k])).alias(k) for k in ("group_0_sample_size", "group_1_sample_size")],
        C.to_member(_c("Sequencing type"), V.SEQUENCING_TYPE).alias("sequencing_type"),
        low.alias("variable_region_lower_bound"),
        high.alias("variable_region_upper_bound"),
        C.none_if_empty(C.to_members(T.split_strict(_c("Sequencing platform")), V.PLATFORM)).alias("sequencing_platform"),
        C.to_member(_c("Data transformation"), V.DATA_TRANSFORMATION).alias("data_transformation"),
        C.none_if_empty(C.to_members(T.split_strict(_c("Statistical test")), V.STATISTICAL_TEST)).alias("statistical_test"),
        *[C.to_float(_c(EXPERIMENT[k])).alias(k) for k in ("significance_threshold", "lda_score_above")],
        C.to_bool(_c("MHT correction")).alias("mht_correction"),
        *[C.to_member(_c(EXPERIMENT[k]), V.ALPHA_CHANGE).alias(k) for k in ("pielou", "shannon", "chao1", "simpson", "inverse_simpson", "richness")],
    ]


def signature_fields() -> list[Column]:
    return [
        *[C.clean(_c(SIGNATURE[k])).alias(k) for k in ("source", "description")],
        C.to_member(_c("Abundance in Group 1"), V.DIRECTION).alias("abundance_in_group_1"),
        C.none_if_empty(parse_taxa(_c("MetaPhlAn taxon names"), _c("NCBI Taxonomy IDs"))).alias("taxa"),
        C.to_date_text(_c("Curated date")).alias("curated_date"),
        *[C.none_if_empty(T.split_strict(_c(SIGNATURE[k]))).alias(k) for k in ("curator", "revision_editor")],
        C.to_member(_c("State"), V.CURATION_STATE).alias("curation_state"),
    ]


def load_studies(dump: DataFrame, limit: int | None = None) -> DataFrame:
    """uid, study fields and experiments[signatures[taxa]]; blanks are null, as in the JSON writer absent.

    The first row of a study or experiment gives its fields; each row is a signature
    unless its page name is blank. With a limit, reading stops where the row of a
    further study would come.
    """
    rows = dump.withColumns({"uid": C.strip(F.coalesce(_c("Study"), F.lit(""))), "experiment": C.strip(F.coalesce(_c("Experiment"), F.lit("")))})
    if limit is not None:
        stop = rows.groupBy("uid").agg(F.min(ORDER).alias("first")).orderBy("first").offset(limit).limit(1).agg(F.min("first").alias("stop"))
        rows = rows.join(F.broadcast(stop), F.col("stop").isNull() | (F.col(ORDER) < F.col("stop"))).drop("stop")  # one row
    signature = F.when(~C.is_blank(_c("Signature page name")), F.struct(ORDER, *signature_fields()))
    # Cells of parents are read once for each parent: of its rows only the first one's raw cells come through the grouping.
    cells = F.struct(*[_c(c) for c in (*STUDY_CELLS, *EXPERIMENT.values())])
    # Rows are dealt by study once, their signatures made before: both groupings then work within, on what is made.
    dealt = rows.select("uid", "experiment", ORDER, cells.alias("cells"), signature.alias("signature")).repartition("uid")
    raw = dealt.groupBy("uid", "experiment").agg(F.min(ORDER).alias("first"), F.min_by("cells", ORDER).alias("r"), F.array_sort(F.collect_list("signature")).alias("signatures"))
    bare = F.transform("signatures", lambda x: x.dropFields(ORDER))
    one = F.struct("first", "experiment", *experiment_fields(), C.none_if_empty(bare).alias("signatures"))
    experiments = raw.select("uid", "experiment", "first", "signatures", "r.*").select("uid", "first", F.struct(*[_c(c) for c in STUDY_CELLS]).alias("r"), one.alias("one"))
    studies = experiments.groupBy("uid").agg(F.min("first").alias("first"), F.min_by("r", "first").alias("r"), F.array_sort(F.collect_list("one")).alias("experiments"))
    nested = F.transform("experiments", lambda x: x.dropFields("first"))
    return studies.select("uid", "first", nested.alias("experiments"), "r.*").select("uid", *study_fields(), "experiments", F.col("first").alias(ORDER))


def summarize(studies: DataFrame) -> DataFrame:
    """Numbers of studies, experiments and signatures."""
    sizes = F.aggregate("experiments", F.lit(0).cast("long"), lambda s, e: s + F.when(e["signatures"].isNull(), 0).otherwise(F.size(e["signatures"])))
    return studies.agg(F.count("*").alias("studies"), F.coalesce(F.sum(F.size("experiments").cast("long")), F.lit(0)).alias("experiments"), F.coalesce(F.sum(sizes), F.lit(0)).alias("signatures"))
