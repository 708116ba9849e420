"""The engine: posts, dictionary and the last result, shared with plugins."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterable
from dataclasses import fields, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tagloom.operators import search as searching
from tagloom.operators.search import SearchSpec
from tagloom.plans.query import append_tag
from tagloom.sources.posts import read_posts


class Engine:
    """Holds the posts and the last result. Plugins get the engine and may listen for results.

    Folders: ``base`` (the working folder unless given), and below it data and extensions."""

    def __init__(self, spark: SparkSession, *paths: str, posts: DataFrame | None = None, base: str | None = None):
        self.spark = spark
        self.base = Path(base) if base else Path.cwd()
        self.posts = read_posts(spark, *paths) if posts is None else posts
        self.spec = SearchSpec()
        self.result: DataFrame | None = None
        self.status = ""
        self.plugins: list[str] = []
        self.errors: dict[str, str] = {}
        self._listeners: list[Callable[[DataFrame], None]] = []

    def search(self, spec: SearchSpec | str | None = None) -> DataFrame:
        if spec is not None:
            self.spec = SearchSpec(query=spec) if isinstance(spec, str) else spec
        self.result = searching.search(self.posts, self.spec)
        self.refresh()
        return self.result

    @property
    def query(self) -> str:
        return self.spec.query

    def set_query(self, text: str | None) -> None:
        """The text that the next search() without an argument takes; the filters stay."""
        self.spec = replace(self.spec, query=(text or "").strip())

    @property
    def last_filters(self) -> dict[str, object]:
        """What the last search asked for beside its query, where it is not the default."""
        plain = SearchSpec()
        return {f.name: getattr(self.spec, f.name) for f in fields(SearchSpec) if f.name != "query" and getattr(self.spec, f.name) != getattr(plain, f.name)}

    @property
    def data_dir(self) -> Path:
        return self.base / "data"

    @property
    def extensions_dir(self) -> Path:
        return self.base / "extensions"

    def set_status(self, text: object) -> None:
        self.status = str(text)

    def refresh(self) -> None:
        """Tell the listeners of the result again."""
        if self.result is not None:
            for listener in self._listeners:
                listener(self.result)

    def add_to_query(self, tag: str) -> str:
        return append_tag(self.spec.query, tag)

    def on_result(self, listener: Callable[[DataFrame], None]) -> None:
        self._listeners.append(listener)

    def register(self, name: str, plugin: object) -> bool:
        """Start a plugin by its setup(engine), or else register(engine); False without either.
        What it raises is kept in errors and harms nothing else."""
        start = getattr(plugin, "setup", None) or getattr(plugin, "register", None)
        if start is None:
            return False
        try:
            start(self)
        except Exception as e:  # noqa: BLE001
            self.errors[name] = str(e)
            return False
        self.plugins.append(name)
        return True

    def load_plugins(self, folder: str) -> Iterable[str]:
        """Import and register every module of a folder but __init__."""
        for path in sorted(Path(folder).glob("*.py")):
            if path.stem == "__init__":
                continue
            try:
                spec = importlib.util.spec_from_file_location(path.stem, path)
                module = importlib.util.module_from_spec(spec)
                spec.loader.exec_module(module)
            except Exception as e:  # noqa: BLE001
                self.errors[path.stem] = str(e)
                continue
            self.register(path.stem, module)
        return self.plugins
