"""Model back ends with fallbacks, retries until a target, budgets' limits: decided over sets of attempts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Backends:
    """Named back ends.  Each maps a DataFrame to a Column of struct(ok boolean, value string, reason string)."""

    def __init__(self) -> None:
        self._calls: dict[str, Callable[[DataFrame], Column]] = {}
        self._can: dict[str, tuple[str, ...]] = {}
        self._plain: set[str] = set()

    def register(self, name: str, capabilities: tuple[str, ...], call: Callable[[DataFrame], Column], plain: bool = False) -> None:
        """``plain``: a mere function, whose attempt counts as a success in the log even where it gives no value; routing moves on
        all the same.
        """
        if name in self._calls:
            raise ValueError(f"back end registered twice: {name}")
        self._calls[name], self._can[name] = call, capabilities
        if plain:
            self._plain.add(name)

    def supports(self, name: str, capability: str) -> bool:
        return capability in self._can[name]

    def route(self, df: DataFrame, capability: str, primary: str, *fallbacks: str) -> DataFrame:
        """Adds value, backend, status (success, fallback, failed) and attempts (backend, status, reason).

        The first back end that succeeds gives the value; later ones are not tried.  KeyError for unknown names.
        """
        done = lambda name, status, reason=None: F.struct(F.lit(name).alias("backend"), (status if isinstance(status, Column) else F.lit(status)).alias("status"), (F.lit(None) if reason is None else reason).cast("string").alias("reason"))
        out = df.withColumns({"value": F.lit(None).cast("string"), "backend": F.lit(None).cast("string"), "attempts": F.array().cast("array<struct<backend:string,status:string,reason:string>>")})
        for name in (primary, *fallbacks):
            open_ = F.col("backend").isNull()
            if not self.supports(name, capability):
                out = out.withColumn("attempts", F.when(open_, F.concat("attempts", F.array(done(name, "unsupported")))).otherwise(F.col("attempts")))
                continue
            out = out.withColumn("_r", F.when(open_, self._calls[name](out)))
            done_well = open_ & F.coalesce(F.col("_r.ok"), F.lit(False))
            ok = done_well & F.col("_r.value").isNotNull()
            told = done_well if name in self._plain else ok
            out = out.withColumns({
                "attempts": F.when(open_, F.concat("attempts", F.array(done(name, F.when(told, "success").otherwise("failed"), F.col("_r.reason"))))).otherwise(F.col("attempts")),
                "value": F.when(ok, F.col("_r.value")).otherwise(F.col("value")),
                "backend": F.when(ok, F.lit(name)).otherwise(F.col("backend")),
            }).drop("_r")
        return out.withColumn("status", F.when(F.col("backend").isNull(), "failed").when(F.col("backend") == primary, "success").otherwise("fallback"))


#: One client a Python worker, by the function that makes it.
_CLIENTS: dict[bytes, object] = {}


def model_call(make: Callable[[], Callable[[list[str]], list[str | None]]], question: Column, batch: int = 32, seconds: float = 60.0) -> Column:
    """struct(ok, value, reason) of a model's answer to each question, asked in batches of at most ``batch``.

    ``make`` gives a client, once a worker process: a function from questions to as many answers (None: no answer).  A batch
    that raises, takes longer than ``seconds`` or gives another number of answers fails as a whole, with the reason; null
    questions are not asked.  An answer of None is no failure: ok is true and the value null.
    """
    from pyspark import cloudpickle

    key = cloudpickle.dumps(make)

    def asked(client, questions: list[str]) -> list[tuple[bool, str | None, str | None]]:
        from concurrent.futures import ThreadPoolExecutor
        from concurrent.futures import TimeoutError as Late

        pool = ThreadPoolExecutor(1)
        try:
            answers = pool.submit(client, questions).result(timeout=seconds)
            if len(answers) != len(questions):
                raise ValueError(f"{len(answers)} answers to {len(questions)} questions")
            return [(True, a, None) for a in answers]
        except Late:
            return [(False, None, "timeout")] * len(questions)
        except Exception as failed:
            return [(False, None, f"{type(failed).__name__}: {failed}")] * len(questions)
        finally:
            pool.shutdown(wait=False, cancel_futures=True)

    @F.pandas_udf("ok boolean, value string, reason string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if key not in _CLIENTS:
            _CLIENTS[key] = cloudpickle.loads(key)()
        for part in parts:
            told: list[tuple[bool, str | None, str | None]] = [(False, None, "no question")] * len(part)
            there = [i for i, q in enumerate(part) if q is not None]
            for a in range(0, len(there), batch):
                some = there[a : a + batch]
                for i, t in zip(some, asked(_CLIENTS[key], [part.iloc[i] for i in some]), strict=True):
                    told[i] = t
            yield pd.DataFrame(told, columns=["ok", "value", "reason"])

    return run(question)


def attempts_needed(attempts: DataFrame, key: str, order: str, target: int, limit: int) -> DataFrame:
    """key, attempts, successes, complete of a run that stops at ``target`` successes or ``limit`` attempts.

    ``attempts``: key, order, ok; one row an attempt that was or would be made.
    """
    run = Window.partitionBy(key).orderBy(order)
    numbered = attempts.withColumns({"_n": F.row_number().over(run), "_ok": F.sum(F.col("ok").cast("int")).over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    made = numbered.where((F.col("_n") <= limit) & ((F.col("_ok") < target) | (F.col("ok") & (F.col("_ok") == target))))
    return made.groupBy(key).agg(F.max("_n").alias("attempts"), F.max("_ok").alias("successes"), (F.max("_ok") >= target).alias("complete"))
