"""Batched prediction and failure triage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions.text import fill, is_email, preview, short_id, truncate
from fleetlens.operators.relations import resolve_user
from fleetlens.operators.validate import missing_fields

BATCH_ROWS = 32  # fixed value: rows per model call

# fixed value: the analysis prompt
PROMPT = """Analyze this build failure. Be concise.

Repo: {repo}
Error: {error}

Logs:
{logs}

Give:
1. Root cause (1 sentence)
2. Fix recommendation
3. Known issue? (if applicable)"""


def predict(
    df: DataFrame, prompt: str, factory: Callable[[], Callable[[list[str]], list[str]]], model: str, as_of: Column,
    concurrency: int | None = None, spread: list[str] | None = None, batch_rows: int = BATCH_ROWS,
) -> DataFrame:
    """Run a model over ``prompt``: the factory once per task, then calls of ``batch_rows`` prompts.

    Null prompts are passed over. ``concurrency`` sets the number of tasks, and so of model instances. Rows stay in
    Arrow, so that a task holds Python objects for one call's prompts only.
    """
    rows = df.repartition(concurrency, *(spread or df.columns)) if concurrency else df

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model_call = None
        for batch in batches:
            prompts, out = batch.column(prompt), [None] * batch.num_rows
            given = np.flatnonzero(prompts.is_valid().to_numpy(zero_copy_only=False)).tolist()
            for a in range(0, len(given), batch_rows):
                model_call = model_call or factory()
                part = given[a : a + batch_rows]
                for i, text in zip(part, model_call(prompts.take(pa.array(part)).to_pylist()), strict=True):
                    out[i] = text
            columns = [*batch.columns, pa.array(out, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "generated_text"])

    schema = T.StructType([*rows.schema.fields, T.StructField("generated_text", T.StringType())])
    return rows.mapInArrow(run, schema).withColumns({"model": F.lit(model), "timestamp": as_of})


def triage(
    failures: DataFrame, directory: DataFrame, factory: Callable[[], Callable[[list[str]], list[str]]], as_of: Column,
    lookup_failed: Column | None = None,
) -> DataFrame:
    """Analyse build failures and address their authors; the first failing stage sets code and status.

    ``failures`` has commit_sha, author_email, repo, logs, error; ``directory`` has email, user_id.
    ``lookup_failed``, over the columns of ``failures``, tells where the directory itself gave no answer, which is another
    stage than a directory that knows nobody of that address.
    """
    if lookup_failed is not None:
        failures = failures.withColumn("_lookup_failed", F.coalesce(lookup_failed, F.lit(False)))
    else:
        failures = failures.withColumn("_lookup_failed", F.lit(False))
    for c in ("commit_sha", "author_email", "repo"):
        failures = failures.withColumn(c, F.trim(F.coalesce(F.col(c), F.lit(""))))
    missing = missing_fields(["commit_sha", "author_email", "repo"])
    rows = failures.withColumn("_missing", missing)
    valid = (F.size("_missing") == 0) & is_email(F.col("author_email"))
    text = fill(PROMPT, repo=F.col("repo"), error=F.col("error"), logs=truncate(F.col("logs")))
    rows = rows.withColumn("_prompt", F.when(valid, text)).drop("logs")
    rows = predict(rows, "_prompt", factory, "analysis", as_of).drop("model")
    rows = resolve_user(rows, directory, "author_email")
    analysis = F.nullif(F.col("generated_text"), F.lit(""))
    # fixed values: codes and statuses per stage, and the message layout
    stages = [
        (F.size("_missing") > 0, "MISSING_REQUIRED_FIELDS", 400),
        (~is_email(F.col("author_email")), "INVALID_EMAIL_FORMAT", 400),
        (analysis.isNull(), "OLLAMA_SERVICE_ERROR", 503),
        (F.col("_lookup_failed"), "SLACK_SERVICE_ERROR", 503),
        (F.col("reason").isNotNull(), "SLACK_USER_NOT_FOUND", 404),
    ]
    message = fill(
        "🚨 *Build Failed* - `{repo}`\n\n*Commit:* `{short}`\n\n*Analysis:*\n{analysis}\n\n"
        "<https://github.com/{repo}/commit/{sha}|View Commit>",
        repo=F.col("repo"), short=short_id(F.col("commit_sha")), analysis=analysis, sha=F.col("commit_sha"),
    )
    code = F.coalesce(*[F.when(bad, F.lit(c)) for bad, c, _ in stages])
    status = F.coalesce(*[F.when(bad, F.lit(n)) for bad, _, n in stages], F.lit(200))
    ok = code.isNull()
    out = rows.withColumns(
        {
            "code": code, "http_status": status, "missing_fields": F.array_join("_missing", ", "),
            "message": F.when(ok, message), "recipient": F.when(ok, F.col("resolved_id")),
            "analysis_preview": F.when(ok, preview(analysis)),
        }
    )
    return out.drop("_missing", "_prompt", "_lookup_failed", "generated_text", "resolved_id", "reason", "timestamp")
