"""Classes of failed calls."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ledgerloom import settings as S


def error_class(source: Column, code: Column, message: Column) -> Column:
    """quota, daily_quota, overloaded, transient, fetch or error; null for a success.

    ``source`` is model, embedding or fetch: the embedding service reports
    both 429 and 503 as quota, and only there a message that names a request
    ceiling means the day is spent.
    """
    daily = F.coalesce(message.rlike(S.DAILY_QUOTA_PATTERN), F.lit(False))
    dropped = F.coalesce(message.rlike(rf"\b(?:{'|'.join(S.TRANSIENT_ERRORS)})\b"), F.lit(False))
    embedding = source == "embedding"
    fetch = source == "fetch"
    return (
        F.when(code.isNull() & message.isNull(), F.lit(None).cast("string"))
        .when(code.between(200, 299), F.lit(None).cast("string"))
        .when(fetch & code.isNotNull(), "fetch")
        .when(embedding & code.isin(429, 503) & daily, "daily_quota")
        .when(embedding & code.isin(429, 503), "quota")
        .when(code == 429, "quota")
        .when(code == 503, "overloaded")
        .when(dropped, "transient")
        .otherwise("error")
    )


def retryable(source: Column, code: Column, kind: Column) -> Column:
    """Whether the caller tries again, given the class of the error."""
    return (
        F.when(kind == "fetch", code.isin(*S.FETCH_RETRY_CODES))
        .when(kind == "transient", True)
        .when((source == "model") & (kind == "overloaded"), True)
        .when((source == "embedding") & (kind == "quota"), True)
        .otherwise(False)
    )


def retry_seconds(message: Column, cap: float = S.MAX_RETRY_SECONDS) -> Column:
    """The delay the server asked for, capped; null when it named none."""
    named = F.regexp_extract(message, S.RETRY_DELAY_PATTERN, 1).try_cast("double")
    return F.when(named <= cap, named).when(named > cap, F.lit(cap))
