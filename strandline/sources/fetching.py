"""Fetching as a source: requests are rows, and rounds of answers resolve retries and redirects.

A round asks for the open requests, all at once; each is then done, asked again after a wait, or led on by a redirect. Who
answers is a parameter: `recorded` joins a table of answers, `over` calls a transport in the tasks that hold a host. Rounds
are bounded by the attempts and redirects that a request may take, and each is written to the shared checkpoint folder, so
a lost executor repeats a round's share and not the fetches before. Bodies of recorded answers are not in the rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

ATTEMPTS, REDIRECTS = 3, 20
ANSWER = "status int, location string, content_type string, body binary, error string"
_FIELDS = [f.split()[0] for f in ANSWER.split(", ")]
#: From a transport: status, location, content type, body; an exception is a transport error.
Transport = Callable[[str], tuple[int, str | None, str | None, bytes | None]]
Answer = Callable[[DataFrame], DataFrame]


class Recorded:
    """Answers from a table (url, attempt, status, location, content_type, body, error); what it lacks is a transport error.

    Rounds carry a hash of a body. The bodies stay in the table until all rounds are done, and meet only the last answers.
    """

    def __init__(self, answers: DataFrame):
        self.bodies = answers.filter("body is not null").select("url", "attempt", F.xxhash64("body").alias("mark"), "body")
        rest = [f for f in _FIELDS if f != "body"]
        self.known = checkpointed(answers.select("url", "attempt", *rest, F.when(F.col("body").isNotNull(), F.xxhash64("body")).alias("mark"), F.lit(True).alias("__known")))

    def __call__(self, requests: DataFrame) -> DataFrame:
        asked = [r.attempt for r in requests.select("attempt").distinct().collect()]  # others need not be moved
        met = requests.join(self.known.filter(F.col("attempt").isin(asked)), ["url", "attempt"], "left")
        return met.withColumn("error", F.when(F.col("__known").isNull(), "no answer").otherwise(F.col("error"))).drop("__known")

    def with_bodies(self, done: DataFrame) -> DataFrame:
        """done with body in place of mark; rows of one url, attempt and body are one."""
        key = ["url", "attempt", "mark"]
        return done.join(self.bodies.dropDuplicates(key), key, "left").drop("mark")


def recorded(answers: DataFrame) -> Answer:
    """Answers from a table, as Recorded says."""
    return Recorded(answers)


def over(transport: Transport, partitions: int | None = None) -> Answer:
    """Answers by a transport, each host's requests in one task, one after the other."""

    def answer(requests: DataFrame) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                rows = []
                for url in f["url"]:
                    try:
                        rows.append((*transport(url), None))
                    except Exception as e:  # noqa: BLE001  whatever a transport raises is an answer
                        rows.append((None, None, None, None, type(e).__name__))
                got = pd.DataFrame(rows, columns=_FIELDS)
                yield pd.concat([f[["request", "url", "chain", "attempt", "waited"]].reset_index(drop=True), got.astype({"status": "Int32"})], axis=1)

        host = F.lower(F.regexp_extract("url", r"://([^/?#]*)", 1))
        dealt = requests.repartition(partitions or int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions")), host)
        return dealt.mapInPandas(run, f"request string, url string, chain array<string>, attempt int, waited double, {ANSWER}")

    return answer


def retrieved(urls: DataFrame, answer: Answer, attempts: int = ATTEMPTS, redirects: int = REDIRECTS) -> DataFrame:
    """(url, final_url, chain, attempts, waited, status, content_type, is_html, body, error, outcome) of urls (url), each once.

    Transport errors and answers of 500 and up are asked again from the first URL, after 1, 2, 4.. seconds, which are added up
    and not slept. Redirects are followed, relative ones too. outcome: ok (404 counts as an answer), refused (other 4xx),
    server_error, transport_error or too_many_redirects. Null urls are left out; an empty table gives no rows.
    """
    open_ = urls.filter("url is not null").select(F.col("url").alias("request")).distinct().select("request", F.col("request").alias("url"), F.array("request").alias("chain"), F.lit(1).alias("attempt"), F.lit(0.0).alias("waited"))
    resolve = F.udf(lambda base, location: _joined(base, location), "string")
    failed = F.col("error").isNotNull() | F.coalesce(F.col("status") >= 500, F.lit(True))
    again = failed & (F.col("attempt") < attempts)
    moved = ~failed & F.col("status").isin(301, 302, 303, 307, 308) & F.col("location").isNotNull()
    onward = moved & (F.size("chain") <= redirects)
    outcome = F.when(F.col("error").isNotNull() | F.col("status").isNull(), "transport_error").when(F.col("status") >= 500, "server_error").when(moved, "too_many_redirects").when((F.col("status") >= 400) & (F.col("status") != 404), "refused").otherwise("ok")
    done = None
    for _ in range(attempts * (redirects + 1)):
        met = checkpointed(answer(open_))
        ended = met.filter(~again & ~onward).withColumn("outcome", outcome)
        done = ended if done is None else done.unionByName(ended)
        retried = met.filter(again).select("request", F.col("request").alias("url"), F.array("request").alias("chain"), (F.col("attempt") + 1).alias("attempt"), (F.col("waited") + F.pow(F.lit(2.0), F.col("attempt") - 1)).alias("waited"))
        led = met.filter(onward).select("request", resolve("url", "location").alias("url"), "chain", "attempt", "waited").withColumn("chain", F.concat("chain", F.array("url")))
        open_ = retried.unionByName(led)
        if open_.isEmpty():
            break
    if isinstance(answer, Recorded):
        done = answer.with_bodies(done)
    html = F.coalesce(F.lower("content_type").contains("html"), F.lit(False))
    return done.select(F.col("request").alias("url"), F.col("url").alias("final_url"), "chain", F.col("attempt").alias("attempts"), "waited", "status", "content_type", html.alias("is_html"), "body", "error", "outcome")


def _joined(base: str, location: str) -> str:
    try:
        return urljoin(base, location)
    except ValueError:
        return location
