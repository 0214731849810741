"""Workspaces: one database a session, and a registry of sessions."""

from __future__ import annotations

import re
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources import io
from ..sources.versions import VersionLog

REGISTRY = "session_id string, schema_name string, name string, name_source string, status string, order_count long, chat_count long, audit_count long, created_at timestamp, updated_at timestamp"
TABLES = {"raw_chats": io.CHATS, "order_dataset": io.ORDERS, "stage2_match_audits": io.AUDITS}


def schema_name(session_id: str) -> str:
    name = "session_" + session_id.replace("-", "")
    if not re.fullmatch(r"session_[0-9a-f]{32}", name):
        raise ValueError(f"no session id: {session_id}")
    return name


def require_test_database(spark: SparkSession) -> str:
    """The guard of session workspaces: spark.tallyloom.session.test must be on, and spark.tallyloom.session.database be the name that
    spark.tallyloom.session.expected gives and end in _session_test. Returns the name; raises otherwise."""
    name, expected = spark.conf.get("spark.tallyloom.session.database", ""), spark.conf.get("spark.tallyloom.session.expected", "")
    if spark.conf.get("spark.tallyloom.session.test", "").lower() not in ("1", "true", "on") or not name.endswith("_session_test") or name != expected:
        raise RuntimeError("session workspaces work only on an isolated test database")
    return name


def first_setting(spark: SparkSession, *names: str, default: str = "") -> str:
    """The first of some settings that is set and not blank."""
    return next((v for v in (spark.conf.get(n, "").strip() for n in names) if v), default)


class Workspace:
    """Sessions in a catalog. The registry, a row a session, is a log of versions in the warehouse: each change puts the next one, anew if
    another writer was first, so that writers at once lose nothing and a crash leaves the version before."""

    def __init__(self, spark: SparkSession, registry: str = "default.extraction_sessions"):
        self.spark = spark
        self.log = VersionLog(spark, f"{spark.conf.get('spark.sql.warehouse.dir')}/{registry.replace('.', '_')}.versions")

    def _rows(self, content: dict | None = None) -> list[dict]:
        rows = (self.log.latest()[1] if content is None else content).get("sessions", [])
        return [r | {c: datetime.fromisoformat(r[c]) for c in ("created_at", "updated_at")} for r in rows]

    def sessions(self, archived: bool = False) -> DataFrame:
        names = [c.split()[0] for c in REGISTRY.split(", ")]
        rows = self.spark.createDataFrame([tuple(r[n] for n in names) for r in self._rows()], REGISTRY)
        rows = rows if archived else rows.where("status = 'active'")
        return rows.orderBy(F.desc("updated_at"), F.desc("created_at"), F.desc("session_id"))

    def _rewrite(self, change) -> None:
        """The registry after change(its rows)."""
        told = lambda rows: {"sessions": [r | {c: r[c].isoformat() for c in ("created_at", "updated_at")} for r in rows]}
        self.log.change(lambda content: told(change(self._rows(content))))

    def create(self, name: str | None = None) -> str:
        session_id, now = str(uuid.uuid4()), datetime.now()
        schema = schema_name(session_id)
        self.spark.sql(f"CREATE DATABASE `{schema}`")
        for table, columns in TABLES.items():
            self.spark.createDataFrame([], columns).write.format("parquet").saveAsTable(f"`{schema}`.{table}")

        def added(rows):
            row = {"session_id": session_id, "schema_name": schema, "name": self._clean(name) or f"Session {len(rows) + 1}", "name_source": "manual" if name else "auto", "status": "active"}
            return [*rows, row | {"order_count": 0, "chat_count": 0, "audit_count": 0, "created_at": now, "updated_at": now}]

        self._rewrite(added)
        return session_id

    @staticmethod
    def _clean(name: str | None) -> str:
        return " ".join((name or "").split())[:120]

    def activate(self, session_id: str) -> None:
        if not any(r["session_id"] == session_id and r["status"] == "active" for r in self._rows()):
            raise ValueError(f"no active session: {session_id}")
        self.spark.catalog.setCurrentDatabase(schema_name(session_id))

    def _change(self, session_id: str, when=lambda row: True, **values) -> None:
        values |= {"updated_at": datetime.now()}
        self._rewrite(lambda rows: [r | values if r["session_id"] == session_id and when(r) else r for r in rows])

    def touch(self, session_id: str) -> None:
        """Marks a session as used now."""
        self._change(session_id)

    def rename(self, session_id: str, name: str) -> None:
        self._change(session_id, name=self._clean(name), name_source="manual")

    def archive(self, session_id: str) -> None:
        self._change(session_id, status="archived")

    def restore(self, session_id: str) -> None:
        self._change(session_id, status="active")

    def auto_name(self, session_id: str, name: str) -> None:
        """Names a session whose name nobody has given, also if somebody gives it one meanwhile."""
        self._change(session_id, when=lambda r: r["name_source"] == "auto", name=name)

    def refresh_counts(self, session_id: str) -> None:
        schema = schema_name(session_id)
        names = zip(("chat_count", "order_count", "audit_count"), TABLES)
        self._change(session_id, **{c: self.spark.table(f"`{schema}`.{t}").count() for c, t in names})

    def delete(self, session_id: str) -> None:
        self.spark.sql(f"DROP DATABASE IF EXISTS `{schema_name(session_id)}` CASCADE")
        self._rewrite(lambda rows: [r for r in rows if r["session_id"] != session_id])

    def migrate(self, session_id: str) -> dict[str, list[str]]:
        """Brings a session's tables up to the columns of TABLES, whatever version made them: tables that lack are made, columns that lack are
        added at the end, blank in the rows that are there. Returns what was added, by table; nothing the second time."""
        schema, added = schema_name(session_id), {}
        for table, columns in TABLES.items():
            name = f"`{schema}`.{table}"
            if not self.spark.catalog.tableExists(name):
                self.spark.createDataFrame([], columns).write.format("parquet").saveAsTable(name)
                added[table] = self.spark.table(name).columns
                continue
            have = {c.lower() for c in self.spark.table(name).columns}
            new = [f for f in StructType.fromDDL(columns) if f.name.lower() not in have]
            if new:
                self.spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in new)})")
                added[table] = [f.name for f in new]
        return added

    def reset(self, session_id: str) -> dict[str, int]:
        """Empties a session's tables and says how many rows went."""
        schema, gone = schema_name(session_id), {}
        for table, columns in TABLES.items():
            gone[table] = self.spark.table(f"`{schema}`.{table}").count()
            self.spark.createDataFrame([], columns).write.format("parquet").mode("overwrite").saveAsTable(f"`{schema}`.{table}")
        return gone
