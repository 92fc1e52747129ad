"""Queries over projects and chunks: look-ups, statistics, writes, referential checks, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retrix.operators import writes as W
from retrix.plans.registry import query
from retrix.sources.tables import table

ONCE = "WITH c AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at NULLS FIRST) AS n FROM chunks) WHERE n = 1)"


def chunks(spark: SparkSession, directory: str) -> DataFrame:
    """Each chunk once, as first delivered."""
    return W.latest(table(spark, directory, "chunks"), ["id"], F.asc_nulls_first("created_at"))


@query("SELECT id, name, status FROM projects WHERE id = (SELECT min(id) FROM projects)")
def project_get(spark: SparkSession, directory: str) -> DataFrame:
    """One project by id."""
    projects = table(spark, directory, "projects")
    return projects.join(projects.agg(F.min("id").alias("id")), "id", "left_semi").select("id", "name", "status")


@query("SELECT id, name FROM projects WHERE lower(name) = (SELECT max(lower(name)) FROM projects)")
def project_by_name(spark: SparkSession, directory: str) -> DataFrame:
    """One project by its name, whatever its case."""
    projects = table(spark, directory, "projects").select("id", "name", F.lower("name").alias("key"))
    return projects.join(projects.agg(F.max("key").alias("key")), "key", "left_semi").select("id", "name")


@query("SELECT id, name, created_at FROM projects WHERE status = 'active' ORDER BY created_at DESC, id LIMIT 10 OFFSET 5")
def list_projects_page(spark: SparkSession, directory: str) -> DataFrame:
    """A page of the active projects, the newest first."""
    return table(spark, directory, "projects").where("status = 'active'").orderBy(F.desc("created_at"), "id").offset(5).limit(10).select("id", "name", "created_at")


@query("SELECT id, EXISTS (SELECT 1 FROM chunks c WHERE c.project_id = p.id) AS used FROM projects p")
def project_exists(spark: SparkSession, directory: str) -> DataFrame:
    """Whether a project has chunks."""
    used = table(spark, directory, "chunks").select(F.col("project_id").alias("id")).distinct().withColumn("u", F.lit(True))
    return table(spark, directory, "projects").join(used, "id", "left").select("id", F.coalesce("u", F.lit(False)).alias("used"))


@query(
    ONCE
    + """ SELECT project_id, count(*) AS chunks, count(DISTINCT language) AS languages, count(DISTINCT file_path) AS files, min(created_at) AS first_at, max(created_at) AS last_at FROM c WHERE project_id IS NOT NULL GROUP BY project_id"""
)
def project_stats(spark: SparkSession, directory: str) -> DataFrame:
    """Size, languages, files and times of every project."""
    rows = chunks(spark, directory).where("project_id IS NOT NULL").groupBy("project_id")
    return rows.agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("language").alias("languages"), F.countDistinct("file_path").alias("files"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))


@query(ONCE + " SELECT project_id, language, count(*) AS n FROM c WHERE language IS NOT NULL AND project_id IS NOT NULL GROUP BY ALL")
def project_languages(spark: SparkSession, directory: str) -> DataFrame:
    """Chunks by project and language."""
    return chunks(spark, directory).where("language IS NOT NULL AND project_id IS NOT NULL").groupBy("project_id", "language").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT coverage FROM chunks WHERE coverage IS NOT NULL AND coverage <> ''")
def coverage_distinct(spark: SparkSession, directory: str) -> DataFrame:
    """The kinds of coverage in use."""
    return table(spark, directory, "chunks").where("coverage IS NOT NULL AND coverage <> ''").select("coverage").distinct()


@query(ONCE + " SELECT file_path, min(id) AS id, count(*) AS chunks FROM c WHERE file_path IS NOT NULL GROUP BY file_path")
def id_by_filepath(spark: SparkSession, directory: str) -> DataFrame:
    """The first chunk of every path."""
    return chunks(spark, directory).where("file_path IS NOT NULL").groupBy("file_path").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("chunks"))


@query(ONCE + " SELECT id, project_id FROM c WHERE language = 'python' AND project_id IN (SELECT id FROM projects WHERE status = 'active')")
def chunks_by_language(spark: SparkSession, directory: str) -> DataFrame:
    """Chunks of a language in active projects."""
    active = table(spark, directory, "projects").where("status = 'active'").select(F.col("id").alias("project_id"))
    return chunks(spark, directory).where("language = 'python'").join(active, "project_id", "left_semi").select("id", "project_id")


@query(
    ONCE
    + """, new AS (SELECT id, 'full' AS coverage, project_id FROM c WHERE id LIKE 'a%' AND project_id IN (SELECT id FROM projects))
    SELECT id, coverage, project_id FROM c WHERE id NOT IN (SELECT id FROM new) UNION ALL SELECT * FROM new"""
)
def metadata_upsert(spark: SparkSession, directory: str) -> DataFrame:
    """Chunk records after an upsert that only takes rows of existing projects."""
    rows = chunks(spark, directory).select("id", "coverage", "project_id")
    new = rows.where("id LIKE 'a%'").withColumn("coverage", F.lit("full")).select("id", "coverage", "project_id")
    return W.upsert(rows, W.known(new, "project_id", table(spark, directory, "projects"), "id").select("id", "coverage", "project_id"), ["id"])


@query("SELECT id, name, CASE WHEN id LIKE '%a' THEN 'archived' ELSE status END AS status FROM projects")
def project_update(spark: SparkSession, directory: str) -> DataFrame:
    """Projects after a partial update: null fields of a change leave the old value."""
    projects = table(spark, directory, "projects").select("id", "name", "status")
    changes = projects.where("id LIKE '%a'").select("id", F.lit(None).cast("string").alias("name"), F.lit("archived").alias("status"))
    return W.update_fields(projects, changes, ["id"], ["name", "status"])


@query("SELECT id, name FROM projects UNION ALL SELECT 'new-' || id, name || ' 2' FROM projects WHERE status = 'active'")
def project_create(spark: SparkSession, directory: str) -> DataFrame:
    """Projects after creating some; ids that exist are not created again."""
    projects = table(spark, directory, "projects").select("id", "name")
    active = table(spark, directory, "projects").where("status = 'active'").select(F.concat(F.lit("new-"), "id").alias("id"), F.concat("name", F.lit(" 2")).alias("name"))
    return W.insert_only(projects, active.union(projects.limit(5)), ["id"])


@query(ONCE + ", used AS (SELECT DISTINCT project_id FROM c), gone AS (SELECT id FROM projects WHERE status = 'archived' AND id NOT IN (SELECT project_id FROM used WHERE project_id IS NOT NULL)) SELECT id FROM projects WHERE id NOT IN (SELECT id FROM gone)")
def project_delete_guarded(spark: SparkSession, directory: str) -> DataFrame:
    """Projects after deleting the archived ones, if these have no chunks."""
    projects = table(spark, directory, "projects")
    gone = projects.where("status = 'archived'").select("id")
    return W.delete_cascade(projects, chunks(spark, directory), "id", "project_id", gone)[0].select("id")


@query(ONCE + " SELECT id FROM c WHERE project_id IS NULL OR project_id NOT IN (SELECT id FROM projects WHERE status = 'archived')")
def project_delete_cascade(spark: SparkSession, directory: str) -> DataFrame:
    """Chunks after deleting the archived projects with all they hold."""
    projects = table(spark, directory, "projects")
    gone = projects.where("status = 'archived'").select("id")
    return W.delete_cascade(projects, chunks(spark, directory), "id", "project_id", gone, force=True)[1].select("id")


@query(ONCE + " SELECT id FROM c WHERE project_id IS NULL OR project_id NOT IN (SELECT id FROM projects)")
def chunk_orphans(spark: SparkSession, directory: str) -> DataFrame:
    """Chunks whose project does not exist."""
    return W.orphans(chunks(spark, directory), "project_id", table(spark, directory, "projects"), "id").select("id")


@query(ONCE + " SELECT (SELECT count(*) FROM projects) AS projects, (SELECT count(*) FROM projects WHERE status = 'active') AS active, count(*) AS chunks FROM c")
def api_stats(spark: SparkSession, directory: str) -> DataFrame:
    """Projects, active ones, chunks."""
    projects = table(spark, directory, "projects").agg(F.count(F.lit(1)).alias("projects"), F.count_if(F.col("status") == "active").alias("active"), F.lit(1).alias("one"))
    return projects.join(chunks(spark, directory).agg(F.count(F.lit(1)).alias("chunks"), F.lit(1).alias("one")), "one").drop("one")


@query(
    r"""SELECT id, regexp_replace(name, '[^a-zA-Z0-9_-]', '', 'g') AS clean_id, trim(regexp_replace(description, '[<>"'']', '', 'g')) AS question, length(trim(regexp_replace(description, '[<>"'']', '', 'g'))) >= 3 AS valid FROM projects"""
)
def request_validation(spark: SparkSession, directory: str) -> DataFrame:
    """Inputs as they are cleaned and checked at the edge."""
    question = F.trim(F.regexp_replace("description", "[<>\"']", ""))
    return table(spark, directory, "projects").select("id", F.regexp_replace("name", "[^a-zA-Z0-9_-]", "").alias("clean_id"), question.alias("question"), (F.length(question) >= 3).alias("valid"))


@query("SELECT id, json_extract_string(metadata, '$.team') AS team, json_extract_string(metadata, '$.lang') AS lang FROM projects")
def project_metadata(spark: SparkSession, directory: str) -> DataFrame:
    """Fields of the projects' JSON."""
    return table(spark, directory, "projects").select("id", F.get_json_object("metadata", "$.team").alias("team"), F.get_json_object("metadata", "$.lang").alias("lang"))


@query(ONCE + " SELECT id, chunk_hash IS NOT NULL AND lower(chunk_hash) = sha256(content) AS current FROM c WHERE content IS NOT NULL")
def chunk_hash_check(spark: SparkSession, directory: str) -> DataFrame:
    """Whether a chunk's hash is that of its content."""
    rows = chunks(spark, directory).where("content IS NOT NULL")
    return rows.select("id", (F.col("chunk_hash").isNotNull() & (F.lower("chunk_hash") == F.sha2("content", 256))).alias("current"))
