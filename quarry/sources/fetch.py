"""Detail pages fetched on the executors through an injected getter, with their outcomes.

One page is asked for until its answer is final or the plan of pauses is used up. Answers are
sorted by one table of rules; what a rule calls passing (no answer, too many requests, a failing
server) is asked for again, all else is an outcome.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

#: Politeness floor between requests, first and longest pause before trying again, tries after the first.
PACE, FIRST_PAUSE, LONGEST_PAUSE, RETRIES = 2.0, 10.0, 300.0, 5
SITE = "https://inquiries.example"
OUTCOME = "db_id long, http_status int, reason string, html string"


@dataclass(frozen=True)
class Answer:
    """What a getter returns: status, the address that answered, and the page. Status 0: nothing answered, and why."""

    status: int
    url: str
    text: str = ""


Getter = Callable[[str], Answer]
#: What an answer is, the first rule that holds: a name, and its test of the answer and the path asked for.
RULES: tuple[tuple[str, Callable[[Answer, str], bool]], ...] = (
    ("silent", lambda a, path: a.status == 0),
    ("missing", lambda a, path: a.status == 404),
    ("elsewhere", lambda a, path: path not in a.url),
    ("passing", lambda a, path: a.status == 429 or a.status >= 500),
    ("served", lambda a, path: a.status // 100 == 2),
    ("odd", lambda a, path: True),
)


def kind_of(answer: Answer, path: str) -> str:
    return next(name for name, holds in RULES if holds(answer, path))


def reason_for(kind: str, answer: Answer, retries: int) -> str | None:
    """The words for an outcome. A soft 404 begins with a fixed word, by which dead pages are told."""
    words = {
        "silent": f"no answer: {answer.text}",
        "missing": "not found",
        "elsewhere": f"soft-404: another page answered, {answer.url}",
        "passing": f"gave up after {retries} retries on status {answer.status}",
        "odd": "unexpected status",
    }
    return words.get(kind)


def pauses(first: float, longest: float, retries: int) -> Iterator[float]:
    """Nothing before the first try, then pauses that double up to the longest."""
    yield 0.0
    for k in range(retries):
        yield min(first * 2**k, longest)


def fetch(db_id: int, get: Getter, site: str = SITE, retries: int = RETRIES, first: float = FIRST_PAUSE, longest: float = LONGEST_PAUSE, sleep: Callable[[float], None] = time.sleep) -> tuple[int, str | None, str | None]:
    """(status, reason, html) of one page; html only if it was served."""
    path = f"/{db_id}/"
    answer, kind = Answer(0, "", "no try was made"), "silent"
    for pause in pauses(first, longest, retries):
        if pause:
            sleep(pause)
        try:
            answer = get(f"{site}{path}")
        except OSError as error:
            answer = Answer(0, "", str(error))
        kind = kind_of(answer, path)
        if kind not in ("silent", "passing"):
            break
    return answer.status, reason_for(kind, answer, retries), answer.text if kind == "served" else None


def fetched(queue: DataFrame, get: Getter, pace: float = PACE, sleep: Callable[[float], None] = time.sleep, streams: int = 1, give_up: int | None = None, **options) -> DataFrame:
    """(db_id, http_status, reason, html) for a queue of ids, in the queue's order.

    All requests go through ``streams`` polite streams, one unless the site allows more, so the
    pace holds for the whole cluster. A stream that meets ``give_up`` passing failures in a row
    stops, and returns nothing for the ids it has left. The getter goes to the executors with the task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begun, bad = False, 0
        for batch in batches:
            for db_id in batch["db_id"]:
                if give_up is not None and bad >= give_up:
                    return
                if begun:
                    sleep(pace)
                begun = True
                status, reason, html = fetch(int(db_id), get, sleep=sleep, **options)
                bad = bad + 1 if status in (0, 429) or status >= 500 else 0
                yield pd.DataFrame([(db_id, status, reason, html)], columns=["db_id", "http_status", "reason", "html"])

    return queue.select("db_id").coalesce(streams).mapInPandas(run, OUTCOME)
