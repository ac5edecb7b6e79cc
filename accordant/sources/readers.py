"""Readers.

Each JSON reader is a scan plus a parser over ``(file_path, value)`` rows, so the parser also
works on documents that already sit in a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accordant import names
from accordant.functions import sets
from accordant.functions.labels import classified_label
from accordant.functions.numbers import to_number
from accordant.operators.relations import with_canonical_labels
from accordant.sources.members import member_map, read_member_documents, read_members
from accordant.sources.paths import decoded, file_name, name_parts, path_keys
from accordant.sources.records import numbered_records, read_lines

QUESTION_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in names.SERIES])
SCORE_TABLE_SCHEMA = T.StructType([
    T.StructField("QuestionID", T.IntegerType()),
    T.StructField("JaccardSimilarity", T.DoubleType()),
    T.StructField("IsEmptySet", T.IntegerType()),
    T.StructField("BinaryEqual", T.IntegerType()),
    T.StructField("B_Intersected_C_EmptyCount", T.IntegerType()),
])
MODEL_TYPE = "map<string,struct<ID:int,score:double,release_date:string,company:string,size:string>>"


def read_documents(
    spark: SparkSession, path: str | list[str], glob: str = "*.json", one_per_line: bool = False, in_parts: bool = False
) -> DataFrame:
    """One row per file below ``path``: ``file_path``, ``value`` (the whole text).

    ``one_per_line`` reads files in which every line is a document; such files can be split.
    ``in_parts`` reads files that hold one object ``{id: value}`` of any size each, a row per member
    (``file_path``, ``q_id``, ``raw``; see :mod:`accordant.sources.members`); the parsers take those rows too.
    The options make the local file system accept names with a colon; other file systems ignore
    them.
    """
    if in_parts:
        return read_members(spark, path, glob)
    return (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .option("fs.file.impl", "org.apache.hadoop.fs.RawLocalFileSystem")
        .option("fs.file.impl.disable.cache", "true")
        .text(path, wholetext=not one_per_line)
        .select(decoded(F.col("_metadata.file_path")).alias("file_path"), "value")
    )


def _scanned(spark: SparkSession, path: str | list[str], glob: str, one_per_line: bool = False, in_parts: bool = False) -> DataFrame:
    """:func:`read_documents`; ``in_parts``, members stay together in documents, so that a path is looked at once for many."""
    return read_member_documents(spark, path, glob) if in_parts else read_documents(spark, path, glob, one_per_line)


def parsed(kind: str, value: str = "value") -> Column:
    """The JSON document in ``value``; a malformed one stops the job and names its file.

    A file without a single byte is no row to Spark's readers, so it is no document either.
    """
    found = F.from_json(value, kind, {"mode": "FAILFAST"})
    return F.coalesce(found, F.raise_error(F.concat(F.lit("no JSON document of the expected form in "), F.col("file_path"))))


def _values(documents: DataFrame) -> Column:
    """The ``{id: value}`` document of a row as a map; one that is part of a file must hold as many members as were found there."""
    if "__members" not in documents.columns:
        return parsed("map<string,string>")
    return member_map(F.concat(F.lit("no JSON document of the expected form in "), F.col("file_path")))


def entries(documents: DataFrame) -> DataFrame:
    """Explode ``{id: value}`` documents: ``file_path``, ``q_id``, ``raw`` (value as JSON text)."""
    if "raw" in documents.columns:
        return documents.select("file_path", "q_id", "raw")
    return documents.select("file_path", F.explode(_values(documents)).alias("q_id", "raw"))


def _keyed(
    documents: DataFrame,
    vocabularies: dict[str, list[str]],
    required: list[str],
    defaults: dict[str, str] | None = None,
    ignore_case: bool = False,
) -> DataFrame:
    """Entries of the documents whose paths hold all required keys, with the keys as columns.

    Paths are checked before any text is parsed.
    """
    keys = path_keys(F.col("file_path"), vocabularies, required, defaults, ignore_case)
    keyed = documents.withColumn("k", keys).filter(F.col("k").isNotNull())
    if "raw" not in documents.columns:
        keyed = keyed.select("file_path", "k", F.explode(_values(documents)).alias("q_id", "raw"))
    return keyed.select("file_path", "k.*", "q_id", "raw")


# -- answers ---------------------------------------------------------------------------------


def parse_answers(
    documents: DataFrame,
    llms: list[str],
    datasets: list[str] = names.DATASETS,
    actions: list[str] = names.ACTIONS,
    tasks: list[str] = names.TASKS,
    languages: list[str] = names.LANGUAGES,
    questions: list[str] = names.SERIES,
    name_prefix: str = "Q",
    ignore_case: bool = False,
    starred_language: str | None = None,
) -> DataFrame:
    """Answer documents to rows ``q_id, q_serie, action, task, dataset, lang, llm, answer``.

    A value that is no list gives an empty answer.  Files whose keys cannot be resolved are
    dropped before their text is parsed; ``ignore_case`` resolves keys in any case.  Files of
    another language start with an asterisk and are left out, unless ``starred_language`` says
    which language they are in.
    """
    vocabularies = {
        "q_serie": questions, "action": actions, "task": tasks, "dataset": datasets, "lang": languages, "llm": llms,
    }
    name = file_name(F.col("file_path"))
    named, lang = documents.filter(name.startswith(name_prefix)), F.col("lang")
    if starred_language is not None:
        starred = name.startswith("*" + name_prefix)
        plain = F.when(starred, F.replace("file_path", F.lit("/*"), F.lit("/"))).otherwise(F.col("file_path"))
        named = documents.filter(starred | name.startswith(name_prefix)).withColumns({
            "file_path": F.when(starred, F.concat(F.lit("*"), plain)).otherwise(plain),
        })
        lang = F.when(F.col("file_path").startswith("*"), starred_language).otherwise(lang).alias("lang")
    required = ["q_serie", "action", "task", "dataset", "llm"]
    return (
        _keyed(named, vocabularies, required, {"action": "zero-shot"}, ignore_case)
        .select(
            "q_id", "q_serie", "action", "task", "dataset", lang, "llm",
            sets.or_empty(F.from_json("raw", "array<string>")).alias("answer"),
            "file_path",
        )
    )


def read_answers(
    spark: SparkSession, path: str | list[str], llms: list[str], glob: str = "*.json", one_per_line: bool = False,
    in_parts: bool = False, **vocabulary
) -> DataFrame:
    """Scan a directory tree of answer files; ``in_parts`` reads each file by many tasks."""
    return parse_answers(_scanned(spark, path, glob, one_per_line, in_parts), llms, **vocabulary)


def read_answer_documents(spark: SparkSession, path: str | list[str], llms: list[str], **vocabulary) -> DataFrame:
    """Scan the JSON-lines documents of :func:`accordant.sources.writers.write_answer_documents`."""
    return read_answers(spark, path, llms, "*.txt", True, name_prefix="", **vocabulary)


# -- relation labels -------------------------------------------------------------------------


def parse_relations(
    documents: DataFrame, llms: list[str], datasets: list[str] = names.DATASETS, ignore_case: bool = False,
    name_prefix: str = "Relation",
) -> DataFrame:
    """``{id: [five labels]}`` documents to one row per (q_id, dataset, llm); a shorter list stops the job."""
    named = documents.filter(file_name(F.col("file_path")).startswith(name_prefix))
    keyed = _keyed(named, {"dataset": datasets, "llm": llms}, ["dataset", "llm"], ignore_case=ignore_case).withColumn(
        "labels", F.from_json("raw", "array<string>")
    )
    short = F.raise_error(F.concat(F.lit("fewer than five labels under "), F.col("q_id"), F.lit(" in "), F.col("file_path")))
    keyed = keyed.withColumn("labels", F.when(F.size("labels") >= len(names.RELATIONS), F.col("labels")).otherwise(short))
    return keyed.select(
        "q_id", "dataset", "llm",
        *[F.try_element_at("labels", F.lit(i + 1)).alias(c) for i, c in enumerate(names.RELATIONS)],
        "file_path",
    )


def read_relations(
    spark: SparkSession, path: str | list[str], llms: list[str], glob: str = "Relation*.json", one_per_line: bool = False,
    in_parts: bool = False, **vocabulary
) -> DataFrame:
    return parse_relations(_scanned(spark, path, glob, one_per_line, in_parts), llms, **vocabulary)


# The relation column that each task's classification fills.
TASK_RELATION = {"equal": "r_12", "sup-sub": "r_13", "minus": "r_134"}


def parse_classified_relations(
    documents: DataFrame,
    llms: list[str],
    datasets: list[str] = names.DATASETS,
    tasks: list[str] = names.TASKS,
    ignore_case: bool = False,
) -> DataFrame:
    """Per-task label documents merged to one row per (q_id, dataset, llm).

    Labels are mapped to the canonical ones.  Where two files give the same cell, the file with
    the larger path wins.
    """
    named = documents.filter(~file_name(F.col("file_path")).startswith("Q"))
    vocabularies = {"dataset": datasets, "llm": llms, "task": [t for t in tasks if t in TASK_RELATION]}
    keyed = _keyed(named, vocabularies, list(vocabularies), ignore_case=ignore_case).withColumn(
        "label", classified_label(F.col("raw"))
    )
    labelled = with_canonical_labels(keyed, {"label": "label"})
    cells = [
        F.max_by(F.when(F.col("task") == t, F.col("label")), F.when(F.col("task") == t, F.col("file_path"))).alias(c)
        for t, c in TASK_RELATION.items()
    ]
    return labelled.groupBy("q_id", "dataset", "llm").agg(*cells).withColumn("action", F.lit("classification"))


def read_classified_relations(
    spark: SparkSession, path: str | list[str], llms: list[str], glob: str = "*.json", one_per_line: bool = False,
    in_parts: bool = False, **vocabulary
) -> DataFrame:
    return parse_classified_relations(_scanned(spark, path, glob, one_per_line, in_parts), llms, **vocabulary)


# -- scores ----------------------------------------------------------------------------------


def parse_scores(documents: DataFrame) -> DataFrame:
    """``{id: number}`` documents: ``file, q_id, score``; a value that is no number is NULL."""
    return entries(documents).select(
        file_name(F.col("file_path")).alias("file"), "file_path", "q_id", to_number(F.col("raw")).alias("score")
    )


def read_scores(spark: SparkSession, path: str | list[str], in_parts: bool = False) -> DataFrame:
    return parse_scores(_scanned(spark, path, "*.json", in_parts=in_parts))


def read_score_tables(spark: SparkSession, path: str | list[str], glob: str = "*.tsv") -> DataFrame:
    """Per-question score TSVs with task, model and action taken from the file name."""
    raw = (
        spark.read.schema(SCORE_TABLE_SCHEMA)
        .option("sep", "\t").option("header", "true").option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .option("fs.file.impl", "org.apache.hadoop.fs.RawLocalFileSystem")
        .option("fs.file.impl.disable.cache", "true")
        .csv(path)
    )
    keys = name_parts(decoded(F.col("_metadata.file_name")))
    return raw.select(
        decoded(F.col("_metadata.file_path")).alias("file_path"),
        *[c.alias(k) for k, c in keys.items()],
        *SCORE_TABLE_SCHEMA.fieldNames(),
    )


# -- questions -------------------------------------------------------------------------------


def number_rows(rows: DataFrame) -> DataFrame:
    """Add ``q_index``, the 0-based row position within a file.

    ``rows`` carry ``file_path``, ``block`` (start of the file split) and ``pos``
    (``monotonically_increasing_id`` of the scan).  The position is the row's place within its
    split plus the number of rows in the splits before it, so no file is ever pulled into one task
    to be numbered; only one row per split is shuffled.
    """
    before = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        rows.groupBy("file_path", "block")
        .agg(F.min("pos").alias("first_pos"), F.count("*").alias("n"))
        .select("file_path", "block", "first_pos", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    return rows.join(blocks, ["file_path", "block"]).withColumn(
        "q_index", F.col("offset") + F.col("pos") - F.col("first_pos")
    ).drop("block", "pos", "first_pos", "offset")


def read_questions(
    spark: SparkSession,
    path: str | list[str],
    datasets: list[str] | None = None,
    languages: list[str] | None = None,
    schema: T.StructType = QUESTION_SCHEMA,
    multiline: bool | None = None,
    glob: str = "*.tsv",
) -> DataFrame:
    """Question TSVs ``.../<lang>/<dataset>.tsv`` as ``q_index, Q1.., dataset, lang``.

    Files may also lie below ``lang=<lang>/dataset=<dataset>/`` under any name.  ``q_index`` is the
    0-based row position within the file; the first record is the header.  Quoted texts may hold
    separators, doubled quotes and line ends, and files are split all the same (see
    :mod:`accordant.sources.records`); ``multiline`` is of no effect any more.  Files of other
    datasets and languages go before their lines are brought in order.
    """
    parts = F.split("file_path", "/")

    def directory(key: str) -> Column:
        return F.nullif(F.regexp_extract("file_path", f"/{key}=([^/]+)/", 1), F.lit(""))

    keys = {
        "dataset": F.coalesce(directory("dataset"), F.regexp_replace(F.element_at(parts, -1), r"\.tsv\z", "")),
        "lang": F.coalesce(directory("lang"), F.try_element_at(parts, F.lit(-2))),
    }
    lines = read_lines(spark, path, glob)
    for key, wanted in (("dataset", datasets), ("lang", languages)):
        if wanted is not None:
            lines = lines.filter(keys[key].isin(wanted))
    records = numbered_records(lines).filter("position > 0")
    # Texts keep their blanks and line ends; a field without a character is null.
    options = {"sep": "\t", "quote": '"', "escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"}
    rows = records.select("file_path", "position", F.from_csv("record", schema_text(schema), options).alias("row"))
    return rows.select(
        (F.col("position") - 1).alias("q_index"), "row.*", *[c.alias(k) for k, c in keys.items()], "file_path"
    )


def schema_text(schema: T.StructType) -> str:
    """A schema as DDL text, the form that ``from_csv`` takes."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def parse_question_bank(documents: DataFrame) -> DataFrame:
    """Question documents (a list of items or a single item) as ``uid, question, sparql``.

    Items without a question are dropped; a missing uid becomes ``no_uid_<position>``.
    """
    item = "struct<uid:string,question:string,sparql:string>"
    items = F.when(F.ltrim("value").startswith("["), parsed(f"array<{item}>")).otherwise(F.array(parsed(item)))
    return (
        documents.select("file_path", F.posexplode(items).alias("idx", "item"))
        .filter(F.col("item.question").isNotNull())
        .select(
            F.coalesce(F.col("item.uid"), F.concat(F.lit("no_uid_"), F.col("idx"))).alias("uid"),
            F.col("item.question").alias("question"),
            F.col("item.sparql").alias("sparql"),
            "file_path",
        )
    )


def read_question_bank(spark: SparkSession, path: str | list[str], glob: str = "*.json", one_per_line: bool = False) -> DataFrame:
    return parse_question_bank(read_documents(spark, path, glob, one_per_line))


# -- models and result tables ----------------------------------------------------------------


def parse_models(documents: DataFrame) -> DataFrame:
    """``{model: {ID, score, release_date, company, size}}`` documents as one row per model."""
    return documents.select(F.explode(parsed(MODEL_TYPE)).alias("llm", "m")).select(
        "llm", F.col("m.ID").alias("id"), F.col("m.score").alias("score"),
        F.col("m.release_date").alias("release_date"), F.col("m.company").alias("company"),
        F.col("m.size").alias("size"),
    )


def read_models(spark: SparkSession, path: str) -> DataFrame:
    return parse_models(read_documents(spark, path))


def read_result_table(
    spark: SparkSession, path: str | list[str], schema: T.StructType | str, sep: str = ",", **options
) -> DataFrame:
    """A summary, p-value, relation or heatmap table written by :mod:`accordant.sources.writers`."""
    reader = (
        spark.read.schema(schema).option("header", "true").option("sep", sep)
        .option("quote", '"').option("escape", '"')
    )
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.csv(path)
