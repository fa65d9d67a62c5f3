"""Calls of a model that are paid once: retries that know a quota, and a write-once cache by request.

An answer is one small file named after the canonical form of its request. A job claims a request before
the call, so of several jobs that need the same answer one calls and the others wait for it; a claim
whose job was lost is void after a while. All files go through Hadoop's file system, so any shared
folder will do, whether or not it can create a file exclusively.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of a request that change without changing what is asked, and replies that may pass.
VOLATILE = {"timestamp", "run_id", "conversation_id", "provider_response_id", "provider_details", "id", "metadata"}
RETRYABLE, ATTEMPTS, LONGEST_WAIT = {429, 500, 502, 503, 504}, 6, 90.0
#: Seconds between looks at a claimed answer, and after which a claim counts as that of a lost job.
LOOK, LOST = 0.2, 600.0


class CallError(Exception):
    """A reply that is none, with its status."""

    def __init__(self, status: int, body: str = ""):
        super().__init__(f"{status}: {body[:300]}")
        self.status, self.body = status, body


class QuotaExhausted(Exception):
    """Nothing more can be asked today."""


def canonical(value: Any) -> Any:
    """value without volatile fields, with the keys of every object in order."""
    if isinstance(value, dict):
        return {k: canonical(v) for k, v in sorted(value.items()) if k not in VOLATILE}
    return [canonical(v) for v in value] if isinstance(value, list | tuple) else value


def request_key(model: str, request: Any) -> str:
    """SHA-256 of the canonical form of a request to a model."""
    return hashlib.sha256(json.dumps({"model": model, "request": canonical(request)}, sort_keys=True, default=str, ensure_ascii=False).encode()).hexdigest()


def wait_for(error: CallError, attempt: int) -> float | None:
    """Seconds to wait before another attempt; None if there is to be none."""
    if error.status not in RETRYABLE:
        return None
    asked = re.search(r"retry in ([\d.]+)s", error.body) or re.search(r"retryDelay\W+(\d+)s", error.body)
    return float(asked[1]) + 1 if asked else min(15.0 * attempt, LONGEST_WAIT)


def with_retry(call: Callable[[], Any], sleep: Callable[[float], None] = time.sleep, attempts: int = ATTEMPTS) -> Any:
    """call(), again after failures that may pass; a daily quota ends it with QuotaExhausted."""
    for attempt in range(1, attempts + 1):
        try:
            return call()
        except (ConnectionError, TimeoutError):
            if attempt == attempts:
                raise
            sleep(10.0 * attempt)
        except CallError as error:
            if error.status == 429 and re.search(r"(?i)per ?day|daily", error.body):
                raise QuotaExhausted(error.body[:300]) from error
            wait = wait_for(error, attempt)
            if wait is None or attempt == attempts:
                raise
            sleep(wait)
    raise AssertionError("unreachable")


class CallCache:
    """Answers by request, in a folder that jobs share."""

    def __init__(self, spark: SparkSession, folder: str, sleep: Callable[[float], None] = time.sleep):
        self.spark, self.folder, self.sleep = spark, folder.rstrip("/"), sleep
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self.hits = self.misses = 0

    def _read(self, name: str) -> dict | None:
        path = self._path(f"{self.folder}/{name}")
        if not self._fs.exists(path):
            return None
        return json.loads(self.spark.read.text(path.toString(), wholetext=True).first()[0])

    def _claims(self, key: str) -> list[str]:
        """Names of the claims on key; those of lost jobs are deleted."""
        found = self._fs.globStatus(self._path(f"{self.folder}/{key}.claim.*")) or []
        limit, names = (time.time() - LOST) * 1000, []
        for status in found:
            if status.getModificationTime() < limit:
                self._fs.delete(status.getPath(), False)
            else:
                names.append(status.getPath().getName())
        return names

    def ask(self, model: str, request: Any, call: Callable[[Any], Any]) -> Any:
        """The answer (JSON) to a request: the cached one, or that of call(request), which is made once.

        A job calls when its claim is the only one. Of several claims all but the first by name are
        withdrawn, and the first waits for that, so a job that saw no other claim is never joined.
        """
        key, own = request_key(model, request), None
        try:
            while True:
                held = self._read(f"{key}.json")
                if held is not None:
                    self.hits += 1
                    return held["answer"]
                others = [n for n in self._claims(key) if n != own]
                if own and not others:
                    break
                if not own and not others:
                    own = f"{key}.claim.{uuid.uuid4().hex}"
                    self._fs.create(self._path(f"{self.folder}/{own}"), False).close()
                    continue
                if own and own > min(others):
                    self._fs.delete(self._path(f"{self.folder}/{own}"), False)
                    own = None
                self.sleep(LOOK)
            answer = call(request)
            # Written aside and renamed, so that no one reads half of it.
            aside = self._path(f"{self.folder}/{key}.{uuid.uuid4().hex}.aside")
            out = self._fs.create(aside, False)
            out.write(bytearray(json.dumps({"key": key, "model": model, "answer": answer}, ensure_ascii=False).encode()))
            out.close()
            self._fs.rename(aside, self._path(f"{self.folder}/{key}.json"))
            self.misses += 1
            return answer
        finally:
            if own:
                self._fs.delete(self._path(f"{self.folder}/{own}"), False)

    def table(self) -> DataFrame:
        """(key, model, answer as JSON) of all answers."""
        rows = self.spark.read.text(f"{self.folder}/*.json", wholetext=True)
        field = lambda name: F.get_json_object("value", f"$.{name}").alias(name)
        return rows.select(field("key"), field("model"), field("answer"))


class CachedModel:
    """A model, called as (question, messages), whose answers are cached and whose failures are retried."""

    def __init__(self, name: str, model: Callable, cache: CallCache, sleep: Callable[[float], None] = time.sleep):
        self.name, self.model, self.cache, self.sleep = name, model, cache, sleep

    def __call__(self, question: str, messages: list) -> dict:
        ask = lambda r: with_retry(lambda: self.model(r["question"], r["messages"]), self.sleep)
        return self.cache.ask(self.name, {"question": question, "messages": messages}, ask)
