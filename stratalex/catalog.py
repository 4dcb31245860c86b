"""Sources by name and sessions by alias: where statements about more than one corpus go."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from .lang.parser import program
from .lang.statement import QueryError, Statement
from .session import Session
from .sources import corpus
from .store import shared_dir


class Catalog:
    """Runs programs. A source is a folder of files; its branches are ``main``, the folder itself, and its subfolders. USE
    opens a session on one of them, and later statements go to that session. Sessions keep their tables below ``store``, a
    folder that driver and executors share, and VACUUM removes those that no session needs any more."""

    def __init__(self, spark: SparkSession, store: str | None = None):
        self.spark = spark
        shared = store or shared_dir(spark)
        self.store = f"{shared.rstrip('/')}/catalog-{uuid.uuid4().hex}"
        self.sources: dict[str, str] = {}
        self.sessions: dict[str, tuple[str, str, Session]] = {}
        self.current: str | None = None

    def run(self, text: str) -> list[DataFrame]:
        """One DataFrame for each statement of ``text``; it is parsed as a whole before anything runs."""
        mine = {"create source", "refresh source", "use", "vacuum", "show sources", "show branches", "show stats"}
        return [getattr(self, "_" + s.verb.replace(" ", "_"))(s) if s.verb in mine else self.session.execute(s) for s in program(text)]

    @property
    def session(self) -> Session:
        if self.current is None:
            raise QueryError("no session: USE source.branch AS 'name' first")
        return self.sessions[self.current][2]

    def _rows(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def _folder(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _create_source(self, s: Statement) -> DataFrame:
        name, url = s.args["name"], s.args["url"]
        fs, where = self._folder(url)
        if name in self.sources:
            raise QueryError(f"source {name} exists")
        if not fs.exists(where):
            raise QueryError(f"no folder {url}")
        self.sources[name] = url
        return self._show_sources(s)

    def _known(self, name: str) -> str:
        if name not in self.sources:
            raise QueryError(f"no source {name}")
        return self.sources[name]

    def _refresh_source(self, s: Statement) -> DataFrame:
        """Sessions of the source that hold no edits read its folder again."""
        self._known(s.args["name"])
        rows = []
        for alias, (source, branch, session) in self.sessions.items():
            if source == s.args["name"]:
                edited = bool(session.undo or session.commits)
                if not edited:
                    session.reset(self._files(source, branch))
                rows.append((alias, branch, not edited))
        return self._rows(rows, "session string, branch string, refreshed boolean")

    def _branches(self, source: str) -> list[str]:
        fs, where = self._folder(self._known(source))
        return ["main", *sorted(f.getPath().getName() for f in fs.listStatus(where) if f.isDirectory())]

    def _files(self, source: str, branch: str) -> DataFrame:
        root = self._known(source).rstrip("/")
        return corpus.from_directory(self.spark, root if branch == "main" else f"{root}/{branch}")

    def _use(self, s: Statement) -> DataFrame:
        source, branch, alias = s.args["source"], s.args["branch"], s.args["alias"]
        if branch not in self._branches(source):
            raise QueryError(f"{source} has no branch {branch}")
        if alias not in self.sessions:
            self.sessions[alias] = (source, branch, Session(self.spark, self._files(source, branch), alias, f"{self.store}/{uuid.uuid4().hex}"))
        elif self.sessions[alias][:2] != (source, branch):
            raise QueryError(f"{alias} is a session of {'.'.join(self.sessions[alias][:2])}")
        self.current = alias
        return self._rows([(alias, source, branch)], "session string, source string, branch string")

    def _show_sources(self, s: Statement) -> DataFrame:
        return self._rows(sorted(self.sources.items()), "name string, path string")

    def _show_branches(self, s: Statement) -> DataFrame:
        _ = self.session
        return self._rows([(b,) for b in self._branches(self.sessions[self.current][0])], "branch string")

    def _show_stats(self, s: Statement) -> DataFrame:
        names = [s.args["of"]] if s.args["of"] else [*self.sessions]
        if any(n not in self.sessions for n in names):
            raise QueryError(f"no session {names[0]}")
        return self._rows(
            [(n, *self.sessions[n][:2], self.sessions[n][2].symbols.count()) for n in names], "session string, source string, branch string, rows long"
        )

    def _vacuum(self, s: Statement) -> DataFrame:
        """Tables of sessions, with what happens to each: what a session can still reach stays, and so do the KEEP newest of
        the rest; ALL takes the rest whole. Nothing is deleted without APPLY."""
        if s.args["source"] is not None:
            self._known(s.args["source"])
        rows = []
        for source, _, session in self.sessions.values():
            if s.args["source"] not in (None, source):
                continue
            live = session.reachable()
            fs, where = self._folder(session.store)
            found = sorted(fs.listStatus(where), key=lambda f: -f.getModificationTime()) if fs.exists(where) else []
            dead = [f for f in found if f.getPath().getName() not in live]
            spared = set() if s.args["all"] else {f.getPath().getName() for f in dead[: s.args["keep"]]}
            for f in found:
                name = f.getPath().getName()
                goes = name not in live and name not in spared
                rows.append((source, name, "delete" if goes else "keep", fs.getContentSummary(f.getPath()).getLength()))
                if goes and s.args["apply"]:
                    fs.delete(f.getPath(), True)
        return self._rows(rows, "source string, name string, action string, bytes long")
