"""The append-only ledger of trials: control-plane rows in SQLite, readable as DataFrames."""

from __future__ import annotations

import hashlib
import json
import sqlite3
import subprocess
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import datetime, timezone
from enum import Enum
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..functions import catalog
from ..functions.expr import grammar_fingerprint


class LedgerError(RuntimeError):
    """The file isn't a usable ledger."""


class UnknownRun(LedgerError, KeyError):
    """The ledger has no run of this id."""


# Stages, verdicts, reasons and columns, by which ledgers are read.


class Stage(Enum):
    GENERATED = "generated"
    SCREENED = "screened"
    GAUNTLET = "gauntlet"
    POOL = "pool"
    ACCEPTED = "pool"


class Verdict(Enum):
    KILLED = "killed"
    PASSED = "passed"
    ACCEPTED = "accepted"


class KillReason(Enum):
    DUPLICATE = "duplicate"
    LOW_COVERAGE = "low_coverage"
    DEGENERATE = "degenerate"
    LOW_IC = "low_ic"
    HIGH_TURNOVER = "high_turnover"
    REDUNDANT = "redundant"
    ROBUSTNESS = "robustness"
    ERROR = "error"


@dataclass(frozen=True)
class Run:
    id: str
    started_at: str
    git_sha: str | None
    source_hash: str
    config: dict[str, Any]
    data_snapshot_id: str | None


@dataclass(frozen=True)
class Trial:
    run_id: str
    expr_hash: str
    expr_str: str
    verdict: Verdict
    stage_reached: Stage
    kill_reason: KillReason | str | None = None
    value_hash: str | None = None
    ic: float | None = None
    ic_ir: float | None = None
    ic_sign: int | None = None
    turnover: float | None = None

    def __post_init__(self):
        if (self.verdict is Verdict.KILLED) != (self.kill_reason is not None):
            raise ValueError("a killed trial has a reason, and only a killed one")


@dataclass(frozen=True)
class PoolEntry:
    trial_id: int
    expr_str: str
    accepted_at: str
    incremental_ic: float | None


_TABLES = {
    "runs": ("id TEXT PRIMARY KEY", "started_at TEXT NOT NULL", "git_sha TEXT", "source_hash TEXT NOT NULL", "config_json TEXT NOT NULL", "data_snapshot_id TEXT"),
    "trials": (
        "id INTEGER PRIMARY KEY", "run_id TEXT NOT NULL REFERENCES runs(id)", "expr_hash TEXT NOT NULL", "expr_str TEXT NOT NULL", "value_hash TEXT",
        "created_at TEXT NOT NULL", "stage_reached TEXT NOT NULL", "ic REAL", "ic_ir REAL", "ic_sign INTEGER", "turnover REAL", "verdict TEXT NOT NULL", "kill_reason TEXT",
    ),
    "pool": ("trial_id INTEGER PRIMARY KEY REFERENCES trials(id)", "accepted_at TEXT NOT NULL", "incremental_ic REAL"),
}
_GUARDED = ("runs", "trials", "pool")


def engine_config() -> dict[str, Any]:
    """Every constant that changes what an expression evaluates to."""
    return {
        "windows": list(catalog.WINDOWS),
        "div_eps": catalog.DIV_EPS,
        "min_periods_fraction": catalog.MIN_PERIODS_FRACTION,
        "min_group_size": catalog.MIN_GROUP_SIZE,
        "zscore_ddof": catalog.ZSCORE_DDOF,
        "grammar_fingerprint": grammar_fingerprint(),
    }


def git_sha(folder: Path | None = None) -> str | None:
    """The commit that the folder stands at, marked -dirty where it differs; None outside a repository."""
    command = ["git", "status", "--porcelain=v2", "--branch"]
    try:
        told = subprocess.run(command, cwd=folder or Path(__file__).parent, capture_output=True, text=True, timeout=10, check=True).stdout
    except (OSError, subprocess.SubprocessError):
        return None
    lines = told.splitlines()
    oid = next((x.split()[-1] for x in lines if x.startswith("# branch.oid ")), "(initial)")
    if oid == "(initial)":
        return None
    return oid + "-dirty" * any(not x.startswith("#") for x in lines)


def source_hash(package: Path | None = None) -> str:
    """Hash of the package's sources, in the order of their paths."""
    root = package or Path(__file__).resolve().parent.parent
    digest = hashlib.sha256()
    for f in sorted(root.rglob("*.py")):
        digest.update(str(f.relative_to(root)).encode() + b"\0" + f.read_bytes())
    return digest.hexdigest()[:32]


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


_LAST_RUN = [0]


def _run_id() -> str:
    """Unique, and later ones sort later: the time and a random part."""
    _LAST_RUN[0] = max(time.time_ns(), _LAST_RUN[0] + 1)
    return f"{_LAST_RUN[0]:016x}{uuid.uuid4().hex[:16]}"


class Ledger:
    """Runs, trials and the pool. No row can be changed or removed."""

    def __init__(self, path: str | Path):
        self.path = str(path)
        self.db = sqlite3.connect(self.path)
        self.db.row_factory = sqlite3.Row
        self.db.execute("PRAGMA foreign_keys = ON")
        self.db.execute("PRAGMA journal_mode = WAL")
        for name, columns in _TABLES.items():
            have = {r["name"] for r in self.db.execute(f"PRAGMA table_info({name})")}
            lacking = {c.split()[0] for c in columns} - have
            if have and lacking:
                raise LedgerError(f"{self.path}: table {name} lacks {sorted(lacking)}; it was written by an older version")
            self.db.execute(f"CREATE TABLE IF NOT EXISTS {name} ({', '.join(columns)})")
        for name in _GUARDED:
            for verb in ("UPDATE", "DELETE"):
                self.db.execute(f"CREATE TRIGGER IF NOT EXISTS {name}_no_{verb.lower()} BEFORE {verb} ON {name} BEGIN SELECT RAISE(ABORT, '{name} is append-only'); END")
        for column in ("expr_hash", "value_hash"):
            self.db.execute(f"CREATE INDEX IF NOT EXISTS trials_{column} ON trials (run_id, {column})")
        self.db.commit()

    def close(self) -> None:
        self.db.close()

    def start_run(self, config: dict[str, Any], data_snapshot_id: str | None = None) -> str:
        engine = engine_config()
        if clash := sorted(set(config) & set(engine)):
            raise ValueError(f"config keys {clash} are the engine's own")
        run_id = _run_id()
        row = (run_id, _now(), git_sha(), source_hash(), json.dumps(engine | config, sort_keys=True), data_snapshot_id)
        with self.db:
            self.db.execute("INSERT INTO runs VALUES (?, ?, ?, ?, ?, ?)", row)
        return run_id

    def run(self, run_id: str) -> Run:
        r = self.db.execute("SELECT * FROM runs WHERE id = ?", (run_id,)).fetchone()
        if r is None:
            raise UnknownRun(f"no run {run_id}")
        return Run(r["id"], r["started_at"], r["git_sha"], r["source_hash"], json.loads(r["config_json"]), r["data_snapshot_id"])

    def log_trial(self, t: Trial) -> int:
        row = (t.run_id, t.expr_hash, t.expr_str, t.value_hash, _now(), t.stage_reached.value, t.ic, t.ic_ir, t.ic_sign, t.turnover, t.verdict.value, getattr(t.kill_reason, "value", t.kill_reason))
        with self.db:
            return self.db.execute(f"INSERT INTO trials VALUES (NULL{', ?' * len(row)})", row).lastrowid

    def trial_count(self, run_id: str) -> int:
        return self.db.execute("SELECT count(*) FROM trials WHERE run_id = ?", (run_id,)).fetchone()[0]

    def has_expr(self, run_id: str, expr_hash: str) -> bool:
        return self.db.execute("SELECT 1 FROM trials WHERE run_id = ? AND expr_hash = ? LIMIT 1", (run_id, expr_hash)).fetchone() is not None

    def seen(self, run_id: str) -> tuple[set[str], dict[str, str]]:
        """Hashes of the run's expressions, and of values with the expression that had them first."""
        rows = self.db.execute("SELECT expr_hash, value_hash FROM trials WHERE run_id = ? ORDER BY id", (run_id,)).fetchall()
        values: dict[str, str] = {}
        for r in rows:
            if r["value_hash"]:
                values.setdefault(r["value_hash"], r["expr_hash"])
        return {r["expr_hash"] for r in rows}, values

    def kill_counts(self, run_id: str) -> dict[str, int]:
        rows = self.db.execute("SELECT kill_reason, count(*) AS n FROM trials WHERE run_id = ? AND kill_reason IS NOT NULL GROUP BY 1", (run_id,))
        return {r["kill_reason"]: r["n"] for r in rows}

    def accept(self, trial_id: int, incremental_ic: float | None = None) -> PoolEntry:
        r = self.db.execute("SELECT * FROM trials WHERE id = ?", (trial_id,)).fetchone()
        if r is None or r["verdict"] != Verdict.ACCEPTED.value:
            raise ValueError(f"trial {trial_id} wasn't accepted")
        entry = PoolEntry(trial_id, r["expr_str"], _now(), incremental_ic)
        try:
            with self.db:
                self.db.execute("INSERT INTO pool VALUES (?, ?, ?)", (trial_id, entry.accepted_at, incremental_ic))
        except sqlite3.IntegrityError as e:
            raise ValueError(f"trial {trial_id} is in the pool already") from e
        return entry

    def pool_entries(self, run_id: str) -> tuple[PoolEntry, ...]:
        rows = self.db.execute("SELECT p.*, t.expr_str FROM pool p JOIN trials t ON t.id = p.trial_id WHERE t.run_id = ? ORDER BY p.accepted_at, p.trial_id", (run_id,))
        return tuple(PoolEntry(r["trial_id"], r["expr_str"], r["accepted_at"], r["incremental_ic"]) for r in rows)

    def trials(self, spark: SparkSession, run_id: str) -> DataFrame:
        """The run's trials as a DataFrame."""
        columns = [c.split()[0] for c in _TABLES["trials"]]
        kinds = {"INTEGER": "long", "REAL": "double", "TEXT": "string"}
        schema = ", ".join(f"{c.split()[0]} {kinds[c.split()[1]]}" for c in _TABLES["trials"])
        rows = self.db.execute("SELECT * FROM trials WHERE run_id = ? ORDER BY id", (run_id,))
        return spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], schema)


@contextmanager
def open_ledger(path: str | Path) -> Iterator[Ledger]:
    ledger = Ledger(path)
    try:
        yield ledger
    finally:
        ledger.close()
