"""Small control tables: log sources, saved searches and alert rules."""

from __future__ import annotations

import base64
import json
import os
import threading
from dataclasses import asdict, dataclass, replace

SOURCE_TYPES = {"LOCAL_FILE": ["path"], "LOCAL_DIRECTORY": ["path"], "SFTP": ["path", "host", "username", "password"], "HTTP": ["path"]}
STATUSES = ("UNVERIFIED", "REACHABLE", "UNREACHABLE")


class Missing(KeyError):
    """There is no such record."""


@dataclass(frozen=True)
class Source:
    name: str
    type: str
    path: str = ""
    host: str = ""
    port: int = 22
    username: str = ""
    password: str = ""
    status: str = "UNVERIFIED"
    enabled: bool = True
    live: bool = False
    id: int = 0


@dataclass(frozen=True)
class Search:
    """A saved search: the arguments of a simple search, or a predicate as SQL text over the log frame."""

    name: str
    where: str = ""
    search: str = ""
    levels: tuple[str, ...] = ()
    source: str | None = None
    file: str | None = None
    range_minutes: int = 0
    sort_by: str = "time"
    direction: str = "desc"
    id: int = 0


@dataclass(frozen=True)
class Event:
    """An alert: when a rule began to trigger and when it stopped."""

    rule_id: int
    triggered_at: str
    resolved_at: str | None = None
    metric_value: float | None = None
    threshold_at_trigger: float | None = None
    notified: bool = False
    id: int = 0


@dataclass(frozen=True)
class Rule:
    """An alert rule over a source, a level, and a predicate as SQL text or words to search."""

    name: str
    rule_type: str = "THRESHOLD"
    window_minutes: int = 5
    metric: str = "COUNT"
    comparison: str = "GT"
    threshold: float | None = None
    baseline_windows: int = 0
    deviations: float = 0.0
    source: str | None = None
    level: str | None = None
    where: str = ""
    search: str = ""
    muted: bool = False
    webhook_url: str = ""
    webhook_secret: str = ""
    id: int = 0


def valid_source(source: Source) -> Source:
    if not source.name.strip():
        raise ValueError("a source needs a name")
    if source.type not in SOURCE_TYPES:
        raise ValueError(f"unknown source type {source.type}")
    for needed in SOURCE_TYPES[source.type]:
        if not str(getattr(source, needed)).strip():
            raise ValueError(f"a {source.type} source needs {needed}")
    if source.type == "HTTP" and not source.path.startswith(("http://", "https://")):
        raise ValueError("an HTTP source needs a URL")
    return source


def valid_rule(rule: Rule) -> Rule:
    from ..operators.alerts import COMPARISONS

    if not rule.name.strip() or rule.window_minutes <= 0:
        raise ValueError("a rule needs a name and a window")
    if rule.rule_type == "THRESHOLD" and (rule.threshold is None or rule.comparison not in COMPARISONS):
        raise ValueError("a threshold rule needs a comparison and a threshold")
    if rule.rule_type == "ANOMALY" and (rule.baseline_windows <= 0 or rule.deviations <= 0):
        raise ValueError("an anomaly rule needs baseline windows and deviations")
    if rule.rule_type not in ("THRESHOLD", "ANOMALY"):
        raise ValueError(f"unknown rule type {rule.rule_type}")
    return rule


def valid_event(event: Event) -> Event:
    return event


def valid_search(search: Search) -> Search:
    if not search.name.strip():
        raise ValueError("a search needs a name")
    return search


SECRETS = ("password", "webhook_secret")
SEALED = "aes:"


class Vault:
    """Seals secrets by AES-GCM with a key of 16, 24 or 32 bytes (Spark's aes_encrypt: a random IV of 12 bytes, then text and tag)."""

    def __init__(self, spark, key: bytes):
        if len(key) not in (16, 24, 32):
            raise ValueError("a key has 16, 24 or 32 bytes")
        self.spark, self.key = spark, key

    def _one(self, function: str, value: bytes) -> bytes:
        from pyspark.sql import functions as F

        frame = self.spark.createDataFrame([(bytearray(value), bytearray(self.key))], "value binary, key binary")  # as data, so that no plan shows them
        return bytes(frame.select(getattr(F, function)("value", "key", F.lit("GCM"))).first()[0])

    def seal(self, text: str) -> str:
        return SEALED + base64.b64encode(self._one("aes_encrypt", text.encode())).decode()

    def open(self, sealed: str) -> str:
        from pyspark.errors import PySparkException

        try:
            return self._one("aes_decrypt", base64.b64decode(sealed.removeprefix(SEALED))).decode()
        except PySparkException as error:
            raise ValueError("a secret can't be opened: another key, or a damaged file") from error


class Records:
    """Records by id, with a check on every change; kept in a JSON file of the driver's, if one is named.

    Secrets are sealed in the file; without a vault they aren't written at all
    and must be given again after a restart. Changes may come from several
    threads.
    """

    def __init__(self, check, path: str | None = None, vault: Vault | None = None):
        self.check, self.path, self.vault = check, path, vault
        self.lock, self.sealed = threading.RLock(), {}
        self.kind = {valid_source: Source, valid_search: Search, valid_rule: Rule, valid_event: Event}[check]
        self.rows: dict[int, object] = {}
        if path and os.path.exists(path):
            with open(path, encoding="utf-8") as file:
                for row in json.load(file):
                    row = {k: tuple(v) if isinstance(v, list) else self._opened(v) if k in SECRETS else v for k, v in row.items()}
                    self.rows[row["id"]] = self.kind(**row)

    def _opened(self, kept: str) -> str:
        if not kept.startswith(SEALED):
            return kept
        if self.vault is None:
            raise ValueError("sealed secrets need their key")
        text = self.vault.open(kept)
        self.sealed[text] = kept
        return text

    def _closed(self, row) -> dict:
        out = asdict(row)
        for name in {*SECRETS} & out.keys():
            if out[name] and self.vault and out[name] not in self.sealed:
                self.sealed[out[name]] = self.vault.seal(out[name])
            out[name] = self.sealed[out[name]] if out[name] and self.vault else ""
        return out

    def _store(self) -> None:
        if self.path:
            with open(self.path + ".new", "w", encoding="utf-8", opener=lambda p, flags: os.open(p, flags, 0o600)) as file:
                json.dump([self._closed(r) for r in self.rows.values()], file)
            os.replace(self.path + ".new", self.path)

    def create(self, row):
        with self.lock:
            row = replace(self.check(row), id=max(self.rows, default=0) + 1)
            self.rows[row.id] = row
            self._store()
        return row

    def get(self, key: int):
        if key not in self.rows:
            raise Missing(key)
        return self.rows[key]

    def update(self, key: int, **changes):
        """Change fields; a blank password or secret keeps the old one, and a changed source is unverified again."""
        with self.lock:
            old = self.get(key)
            changes = {k: v for k, v in changes.items() if not (k in SECRETS and not v)}
            if isinstance(old, Source) and not {"enabled", "live", "status"} >= changes.keys():
                changes["status"] = "UNVERIFIED"
            self.rows[key] = self.check(replace(old, **changes))
            self._store()
            return self.rows[key]

    def delete(self, key: int):
        with self.lock:
            row = self.get(key)
            del self.rows[key]
            self._store()
        return row

    def list(self) -> list:
        return [*self.rows.values()]

    def frame(self, spark):
        from pyspark.sql import functions as F

        hidden = {"password", "webhook_secret", "levels"}
        rows = [{k: v for k, v in vars(r).items() if k not in hidden} for r in self.rows.values()]
        types = {bool: "boolean", int: "long", float: "double"}
        sample = self.kind
        hints = {"threshold": "double", "deviations": "double", "baseline_windows": "int", "window_minutes": "int", "rule_id": "long", "metric_value": "double", "threshold_at_trigger": "double"}
        names = [f for f in sample.__dataclass_fields__ if f not in hidden]
        kinds = [hints.get(n) or types.get(type(sample.__dataclass_fields__[n].default), "string") for n in names]
        schema = ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True))
        out = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)
        return out.withColumn("rule_id", F.col("id")) if sample is Rule else out


def check_local(source: Source) -> tuple[str, str]:
    """REACHABLE or UNREACHABLE, and why, for a local file or directory."""
    good = os.path.isdir(source.path) if source.type == "LOCAL_DIRECTORY" else os.path.isfile(source.path)
    return ("REACHABLE", "ok") if good and os.access(source.path, os.R_OK) else ("UNREACHABLE", f"can't read {source.path}")


def browse(path: str | None = None) -> list[dict]:
    """A directory's entries: directories first, then by name without case."""
    path = path or os.path.expanduser("~")
    if not os.path.isdir(path):
        raise ValueError(f"not a directory: {path}")
    found = [{"name": e.name, "path": e.path, "directory": e.is_dir()} for e in os.scandir(path)]
    return sorted(found, key=lambda e: (not e["directory"], e["name"].lower()))
