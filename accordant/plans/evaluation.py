"""The whole evaluation: from answer, label and question files to result tables.

The analysis table has several consumers, so :func:`evaluate` writes it at once to the shared
folder, dealt by question, and the other tables are lazy plans over that scan; those that bring the
rows of a question together need no exchange for it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accordant import names
from accordant.operators import relations, reshape, rollup, significance
from accordant.operators.analysis import analyse
from accordant.session import laid_out, materialise
from accordant.sources import readers, writers


@dataclass
class Results:
    """Tables of one evaluation, with ASCII column names."""

    relation_table: DataFrame
    analysis: DataFrame
    p_values: DataFrame
    summary: DataFrame
    pairwise: DataFrame


def model_names(models: DataFrame) -> list[str]:
    """Model names in ID order.

    Path keys and matrix columns are made of them, so the list of models comes to the driver, whole.
    """
    return [r.llm for r in models.select("llm", "id").orderBy("id").collect()]


def evaluate(
    answers: DataFrame,
    zero_shot_relations: DataFrame,
    classified_relations: DataFrame,
    models: list[str],
    questions: DataFrame | None = None,
    actions: list[str] = names.ACTIONS,
) -> Results:
    """All result tables from the parsed inputs."""
    analysed = relations.merge_relations_by_action(analyse(answers, questions), zero_shot_relations, classified_relations)
    table = laid_out(analysed, "analysis", ["dataset", "q_id"])
    p_values = significance.action_p_values(table, actions)
    summary = rollup.add_stratified_means(rollup.summarise(table), table)
    return Results(
        relation_table=relations.confusion_table(zero_shot_relations),
        analysis=table,
        p_values=p_values,
        summary=rollup.add_p_values(summary, p_values),
        pairwise=significance.pairwise_p_values(table, models, actions),
    )


def evaluate_files(
    spark: SparkSession,
    answer_dir: str,
    model_file: str,
    question_dir: str | None = None,
    datasets: list[str] = names.DATASETS,
    languages: list[str] = names.LANGUAGES,
    out: str | None = None,
) -> Results:
    """Evaluate a directory tree of answer and label files; with ``out``, write all tables there."""
    models = readers.read_models(spark, model_file)
    llms = model_names(models)
    questions = readers.read_questions(spark, question_dir, datasets, languages) if question_dir else None
    results = evaluate(
        readers.read_answers(spark, answer_dir, llms, datasets=datasets, languages=languages),
        readers.read_relations(spark, f"{answer_dir}/zero-shot", llms, datasets=datasets),
        readers.read_classified_relations(
            spark, f"{answer_dir}/rel_classification_and_questions", llms, datasets=datasets
        ),
        llms,
        questions,
    )
    if out:
        save(results, models, llms, out)
    return results


def save(results: Results, models: DataFrame, llms: list[str], out: str) -> None:
    """Write the result tables as CSV under their symbol names, the analysis as parquet too."""
    summary = materialise(results.summary, "summary")
    writers.write_table(names.to_symbols(results.relation_table), f"{out}/relation_summary", "csv")
    writers.write_table(results.p_values, f"{out}/p_values", "csv", sort_by=["dataset", "llm", "action"])
    writers.write_table(results.analysis, f"{out}/analysis_parquet")
    writers.write_table(names.to_symbols(results.analysis), f"{out}/analysis", "csv")
    writers.write_table(names.to_symbols(summary.orderBy("dataset", "llm", "action")), f"{out}/summary", "csv")
    writers.write_by_action(names.to_symbols(summary), models, f"{out}/summary_by_action")
    symbol = F.create_map(*[F.lit(x) for kv in names.FLAG_SYMBOLS.items() for x in kv])
    wide = reshape.widen_matrix(results.pairwise.withColumn("predicate", symbol[F.col("predicate")]), llms)
    matrix = materialise(wide, "matrix")
    writers.write_table(matrix, f"{out}/p_value_matrices", "csv", sort_by=["action", "dataset", "predicate"])
    writers.write_heatmaps(matrix, llms, f"{out}/heatmaps", "zero-shot", "overall")
