"""Keyword evaluation over labelled text, and ranking measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words whose presence speaks for each task.
TASKS = {
    "confidentiality_of_agreement": ["negotiations", "discussions", "fact that", "agreed", "negotiated", "existence", "status"],
    "explicit_identification": ["marked", "identified", "labeled", "designated", "stamped", "written notice", "clearly identified"],
    "inclusion_of_verbally_conveyed_information": ["oral", "verbally", "orally", "verbal", "spoken", "inspection", "tangible"],
    "limited_use": ["purpose", "limited", "solely", "only for", "restricted", "evaluate", "permitted purpose"],
    "no_licensing": ["license", "licensing", "rights", "grant", "intellectual property", "patent", "trademark", "copyright"],
    "notice_on_compelled_disclosure": ["compelled", "required by law", "legal process", "court order", "subpoena", "notify", "prior notice", "governmental", "regulatory"],
    "permissible_acquirement_of_similar_information": ["independently", "other sources", "third party", "without restriction", "publicly available", "rightfully obtained", "lawfully"],
    "permissible_copy": ["copy", "copies", "reproduce", "reproduction", "duplicate", "replicate"],
    "permissible_development_of_similar_information": ["independently develop", "independent development", "own development", "without use", "without reference"],
    "permissible_post-agreement_possession": ["retain", "keep", "possession", "after termination", "post-termination", "survive", "continue to hold", "not required to return", "not obligated", "may retain", "archival", "one copy", "residual"],
    "return_of_confidential_information": ["return", "destroy", "destruction", "delete", "expunge", "certify", "written confirmation"],
    "sharing_with_employees": ["employee", "personnel", "staff", "representative", "agent", "officer", "director", "need to know"],
    "sharing_with_third-parties": ["third party", "third-party", "affiliate", "subsidiary", "advisor", "consultant", "contractor", "subcontractor", "representative", "agent", "disclose to"],
    "survival_of_obligations": ["survive", "survival", "indefinitely", "continue", "remain in effect", "notwithstanding", "termination"],
}


def tasks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TASKS.items()), "task string, keywords array<string>")


def keyword_scores(texts: DataFrame, tasks: DataFrame) -> DataFrame:
    """Every text under every task (fourteen): how many of the task's words it holds. The short list of tasks is broadcast.

    Words of all tasks are looked for once in each text, which is put to lower case once; a task counts those of its own
    among the ones found, so texts are not repeated by task before they are searched."""
    words = tasks.select(F.explode("keywords").alias("k")).agg(F.collect_set("k").alias("every"))
    listed = tasks.agg(F.collect_list(F.struct("task", "keywords")).alias("tasks"))
    low = texts.withColumn("low", F.lower("text")).join(F.broadcast(words)).join(F.broadcast(listed))
    found = low.withColumn("found", F.filter("every", lambda k: F.contains(F.col("low"), k)))
    scored = F.transform("tasks", lambda t: F.struct(t["task"].alias("task"), F.size(F.filter(t["keywords"], lambda k: F.array_contains(F.col("found"), k))).cast("long").alias("score")))
    return found.select(*texts.columns, F.explode(scored).alias("s")).select(*texts.columns, "s.task", "s.score")


def accuracy(scores: DataFrame, least: int = 2) -> DataFrame:
    """By task: mean score of yes and of no rows as sums and counts, and how many rows a score of ``least`` tells right."""
    right = (F.col("score") >= least) == F.col("label")
    return scores.groupBy("task").agg(F.sum(F.when(F.col("label"), F.col("score")).otherwise(0)).alias("yes_sum"), F.count_if("label").alias("yes_n"), F.sum(F.when(~F.col("label"), F.col("score")).otherwise(0)).alias("no_sum"), F.count_if(~F.col("label")).alias("no_n"), F.count_if(right).alias("right_n"))


#: Words of a question, and what in the clause text speaks for yes.
QUESTIONS = {
    "pii": ["data_protection", "compliance"],
    "data breach": ["data_protection", "compliance"],
    "dispute": ["dispute_resolution"],
    "confidential": ["confidentiality"],
    "choice of law": ["governing_law"],
    "governing": ["governing_law"],
    "indemnif": ["indemnity", "indemnification"],
}


def question_answers(rows: DataFrame) -> DataFrame:
    """Adds ``predicted``: yes if for a word of the question the text holds that word or one of its clause types."""
    ask, told = F.lower("question"), F.lower("text")
    hits = []
    for word, kinds in QUESTIONS.items():
        names = [word, *kinds, *(k.replace("_", " ") for k in kinds)]
        inside = F.lit(False)
        for n in names:
            inside = inside | F.contains(told, F.lit(n))
        hits.append(F.contains(ask, F.lit(word)) & inside)
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return rows.withColumn("predicted", F.when(out, "yes").otherwise("no"))
