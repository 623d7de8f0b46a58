"""Rulesets, their rules and correlations, and the main ruleset. All of it is small and lives on the driver."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from typing import TYPE_CHECKING

from ..functions.timespans import seconds
from .sigma import LEVELS, Rule, RuleError, compile_rule, documents, strings, used_lists
from .value_lists import ValueList, ValueLists, is_list_document, parse_descriptions, parse_documents

if TYPE_CHECKING:
    from pyspark.sql import SparkSession

    from ..sources.sinks import VersionedTable

#: The schema of the table that a catalogue is saved in.
CATALOG = "catalog string"
KINDS = ("event_count", "value_count", "temporal", "temporal_ordered")
COUNT_OPS = ("gte", "gt", "lte", "lt", "eq", "neq")


@dataclass(frozen=True)
class Correlation:
    """A rule over the hits of other rules. base_rules: (title, kind) pairs, kind rule or correlation."""

    id: str
    title: str
    kind: str
    group_by: tuple[str, ...]
    timespan: int
    condition: dict
    base_rules: tuple[tuple[str, str], ...]
    level: str = "informational"
    description: str = ""
    tags: tuple[str, ...] = ()
    name: str = ""

    @property
    def titles(self) -> tuple[str, ...]:
        return tuple(t for t, _ in self.base_rules)

    @property
    def distinct_field(self) -> str | None:
        return self.condition.get("field") if self.kind == "value_count" else None


def check_correlation(doc: dict) -> dict:
    """The correlation part of a document, or an error that says what is wrong."""
    body = doc.get("correlation")
    if not isinstance(body, dict):
        raise RuleError("no correlation")
    kind = body.get("type")
    if kind not in KINDS:
        raise RuleError(f"unknown correlation type {kind!r}")
    if not strings(body.get("rules") or []):
        raise RuleError("a correlation needs rules")
    if not [g for g in strings(body.get("group-by") or []) if g]:
        raise RuleError("a correlation needs group-by")
    if seconds(body.get("timespan")) is None:
        raise RuleError(f"timespan {body.get('timespan')!r} can't be read")
    condition = body.get("condition")
    if condition is not None and (not isinstance(condition, dict) or set(condition) - {*COUNT_OPS, "field"}):
        raise RuleError("only simple conditions are taken")
    if kind in ("event_count", "value_count") and not any(k in COUNT_OPS for k in condition or {}):
        raise RuleError(f"{kind} needs a condition")
    if kind == "value_count" and not condition.get("field"):
        raise RuleError("value_count needs condition.field")
    return body


def resolve_correlations(docs: list[dict]) -> list[Correlation]:
    """Correlations of a pack. References are by name or id of another document of it; a correlation with an unknown one is left out."""
    known: dict[str, tuple[str, str]] = {}
    for d in docs:
        kind = "correlation" if "correlation" in d else "rule"
        for key in (d.get("name"), d.get("id")):
            if key:
                known[str(key)] = (str(d.get("title") or key), kind)
    out = []
    for d in docs:
        if "correlation" not in d:
            continue
        body = check_correlation(d)
        refs = [known.get(str(r)) for r in strings(body["rules"])]
        if any(r is None for r in refs):
            continue
        level = str(d.get("level") or "").lower()
        title = str(d.get("title") or d.get("name") or d.get("id") or "")
        if not title:
            raise RuleError("a correlation needs a title")
        out.append(Correlation(
            str(d.get("id") or d.get("name") or title), title, body["type"], tuple(map(str, strings(body["group-by"]))), seconds(body["timespan"]), dict(body.get("condition") or {}),
            tuple(r for r in refs if r), level if level in LEVELS else "informational", str(d.get("description") or ""), tuple(map(str, strings(d.get("tags") or []))), str(d.get("name") or ""),
        ))
    return out


def load_correlations(spark: SparkSession, path: str) -> list[Correlation]:
    """The correlations of all YAML files under path, by the names and ids of its rules. Those with an unknown reference are left out."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.y*ml").text(path, wholetext=True)
    # A pack is for analysts to write, so it fits the driver.
    texts = [r[0] for r in files.select("value").orderBy("_metadata.file_path").collect()]
    return resolve_correlations([d for t in texts for d in documents(t) if not is_list_document(d)])


def in_order(correlations: list[Correlation]) -> list[Correlation]:
    """Children before parents. What is on a cycle comes in the order given, after what it depends on outside."""
    by_title = {c.title: c for c in correlations}
    left = {c.title: {t for t, k in c.base_rules if k == "correlation" and t in by_title and t != c.title} for c in correlations}
    out: list[Correlation] = []
    while left:
        ready = [t for t, needs in left.items() if not needs & left.keys()] or [_on_cycle(left)]
        for t in ready:
            out.append(by_title[t])
            del left[t]
    return out


def _on_cycle(left: dict[str, set[str]]) -> str:
    """The first title that is on a cycle which needs nothing outside it, when each needs another."""

    def reached(t: str) -> set[str]:
        out: set[str] = set()
        todo = [t]
        while todo:
            new = (left[todo.pop()] & left.keys()) - out
            out |= new
            todo += new
        return out

    reach = {t: reached(t) for t in left}
    return next(t for t in left if all(t in reach[x] for x in reach[t]))


@dataclass
class Ruleset:
    path: str
    name: str
    builtin: bool = False
    docs: dict[str, dict] = field(default_factory=dict)
    compiled: dict[str, list[Rule]] = field(default_factory=dict)

    @property
    def rules(self) -> list[Rule]:
        return [r for rs in self.compiled.values() for r in rs]

    @property
    def correlations(self) -> list[Correlation]:
        return resolve_correlations(list(self.docs.values()))


class Catalog:
    """Rulesets by path, value lists, and what the main ruleset includes."""

    def __init__(self) -> None:
        self.sets: dict[str, Ruleset] = {}
        self.lists = ValueLists()
        self.included_sets: list[str] = []
        self.included: set[tuple[str, str]] = set()
        self.excluded: set[tuple[str, str]] = set()
        self._stamps: dict[str, tuple[int, int]] = {}

    # Rulesets and rules

    def create_ruleset(self, name: str, builtin: bool = False) -> Ruleset:
        path = name if builtin else f"custom_rulesets/{re.sub(r'[^A-Za-z0-9_-]+', '-', name).strip('-').lower() or 'set'}"
        if path in self.sets:
            raise RuleError(f"ruleset {path} exists")
        self.sets[path] = Ruleset(path, name, builtin)
        return self.sets[path]

    def rulesets(self) -> list[dict]:
        return [{"path": s.path, "name": s.name, "builtin": s.builtin, "rules": len(s.rules), "status": self.status(s.path)} for s in self.sets.values()]

    def load_compiled(self, path: str, rules: object) -> Ruleset:
        """A built-in ruleset from a list of rule documents; anything but a list is an error."""
        if not isinstance(rules, list):
            raise RuleError("a ruleset is a list")
        s = self.create_ruleset(path, builtin=True)
        for doc in rules:
            self._put(s, doc)
        return s

    def _compiled(self, doc: dict) -> list[Rule]:
        """A document's rules; an error if they, or its correlation, can't be used."""
        if "correlation" in doc:
            if not doc.get("title"):
                raise RuleError("a correlation needs a title")
            check_correlation(doc)
            return []
        from pyspark.sql import functions as F

        compiled = compile_rule(doc)
        for r in compiled:
            r.predicate(F.col("raw"), self.lists.values)  # raises for a detection that can't be compiled
        return compiled

    def _put(self, s: Ruleset, doc: dict) -> str:
        rule_id = str(doc.get("id") or uuid.uuid4())
        compiled = self._compiled({**doc, "id": rule_id})
        titles = {str(d.get("title")) for i, d in s.docs.items() if i != rule_id}
        if str(doc.get("title")) in titles:
            raise RuleError(f"the ruleset has a rule {doc.get('title')!r}")
        s.docs[rule_id], s.compiled[rule_id] = {**doc, "id": rule_id}, compiled
        return rule_id

    def owner(self, rule_id: str) -> str | None:
        return next((p for p, s in self.sets.items() if rule_id in s.docs), None)

    def save_rule(self, path: str, doc: dict) -> str:
        if doc.get("id") and self.owner(str(doc["id"])):
            raise RuleError(f"rule id {doc['id']} is taken")
        return self._put(self.sets[path], doc)

    def update_rule(self, path: str, rule_id: str, doc: dict) -> None:
        if rule_id not in self.sets[path].docs:
            raise RuleError(f"no rule {rule_id}")
        if doc.get("id") and str(doc["id"]) != rule_id:
            raise RuleError("a rule's id stays")
        self._put(self.sets[path], {**doc, "id": rule_id})

    def delete_rule(self, path: str, rule_id: str) -> bool:
        s = self.sets[path]
        s.compiled.pop(rule_id, None)
        return s.docs.pop(rule_id, None) is not None

    def delete_ruleset(self, path: str) -> bool:
        found = self.sets.pop(path, None) is not None
        self.included_sets = [p for p in self.included_sets if p != path]
        self.included = {x for x in self.included if x[0] != path}
        self.excluded = {x for x in self.excluded if x[0] != path}
        return found

    def get_rule(self, path: str, rule_id: str) -> dict | None:
        return self.sets[path].docs.get(rule_id) if path in self.sets else None

    def upload(self, path: str, text: str, mode: str = "replace") -> dict:
        """A pack of YAML documents: value lists first, then rules. All of it is taken, or nothing: an error leaves the catalogue as it was.

        Returns lists (names by what was done), saved ids, skipped ones, whose id is
        taken, with the owners that have them, and, of the rules elsewhere that use
        a list that changed, those recompiled and those that failed, with why.
        """
        docs = documents(text)
        lists = [d for d in docs if is_list_document(d)]
        before = self.lists.copy(), {p: (dict(s.docs), dict(s.compiled)) for p, s in self.sets.items()}
        try:
            done = self.lists.load(parse_documents(lists), mode, parse_descriptions(lists))
            saved, skipped = [], {}
            for d in docs:
                if is_list_document(d):
                    continue
                owner = self.owner(str(d["id"])) if d.get("id") else None
                if owner:
                    skipped[str(d["id"])] = owner
                else:
                    saved.append(self.save_rule(path, d))
            recompiled, failed = self._recompile(set(done["updated"]) | set(done["created"]), set(saved))
        except BaseException:
            self.lists = before[0]
            for p, (docs_, compiled) in before[1].items():
                self.sets[p].docs, self.sets[p].compiled = docs_, compiled
            raise
        return {"lists": done, "saved": saved, "skipped": list(skipped), "owners": skipped, "recompiled": recompiled, "failed": failed}

    def _recompile(self, names: set[str], but: set[str] = frozenset()) -> tuple[list[str], dict[str, str]]:
        """Compiles the rules that use any of the lists again: ids of those done, and errors of those that keep their last form."""
        done, failed = [], {}
        for s in self.sets.values():
            for rule_id, doc in s.docs.items():
                if rule_id not in but and "correlation" not in doc and names & used_lists([doc]):
                    try:
                        s.compiled[rule_id] = self._compiled(doc)
                        done.append(rule_id)
                    except RuleError as e:
                        failed[rule_id] = str(e)
        return done, failed

    def change_list(self, name: str, values: object) -> dict[str, str]:
        """Sets a list's values and compiles the rules that use it again, with their predicates; those that fail keep their last form and are told."""
        self.lists.update(name, values)
        return self._recompile({name})[1]

    # On disk: one row of JSON behind a versioned table's pointer

    def save(self, table: VersionedTable) -> None:
        """All of the catalogue as the table's next version."""
        said = {
            "sets": [{"path": s.path, "name": s.name, "builtin": s.builtin, "docs": list(s.docs.values())} for s in self.sets.values()],
            "lists": [asdict(x) for x in self.lists.all()],
            "included_sets": self.included_sets,
            "included": sorted(self.included),
            "excluded": sorted(self.excluded),
        }
        table.replace(table.spark.createDataFrame([(json.dumps(said, default=str),)], CATALOG))

    @classmethod
    def load(cls, table: VersionedTable) -> Catalog:
        """The catalogue that was saved last, compiled again; an empty one if there is none. Rules whose lists no longer fit are kept without a compiled form."""
        out, row = cls(), table.read().first()
        if row is None:
            return out
        said = json.loads(row[0])
        for x in said["lists"]:
            out.lists.put(ValueList(**x))
        for s in said["sets"]:
            made = out.sets.setdefault(s["path"], Ruleset(s["path"], s["name"], s["builtin"]))
            for doc in s["docs"]:
                made.docs[doc["id"]] = doc
                try:
                    made.compiled[doc["id"]] = out._compiled(doc)
                except RuleError:
                    made.compiled[doc["id"]] = []
        out.included_sets = said["included_sets"]
        out.included, out.excluded = ({tuple(x) for x in said[k]} for k in ("included", "excluded"))
        return out

    def load_compiled_file(self, spark: SparkSession, path: str) -> Ruleset:
        """A built-in ruleset from a JSON file with a list of rule documents, under the file's name. A file that was loaded as it is now is not read again."""
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        status = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at)
        stamp = (status.getModificationTime(), status.getLen())
        name = at.getName()
        if self._stamps.get(path) == stamp and name in self.sets:
            return self.sets[name]
        rules = json.loads(spark.read.text(path, wholetext=True).first()[0])
        if not isinstance(rules, list):
            raise RuleError("a ruleset is a list")
        self.sets.pop(name, None)
        self._stamps[path] = stamp
        return self.load_compiled(name, rules)

    def list_usage(self) -> dict[str, int]:
        """How many rules use each list."""
        out = {x.name: 0 for x in self.lists.all()}
        for s in self.sets.values():
            for doc in s.docs.values():
                for name in used_lists([doc]) & out.keys():
                    out[name] += 1
        return out

    # The main ruleset: what is included, less what is excluded, and what is picked

    def toggle_ruleset(self, path: str, include: bool) -> None:
        self.included_sets = [p for p in self.included_sets if p != path] + [path] * include
        self.included = {x for x in self.included if x[0] != path}
        self.excluded = {x for x in self.excluded if x[0] != path}

    def toggle_rule(self, path: str, rule_id: str, include: bool) -> None:
        key = (path, rule_id)
        whole = path in self.included_sets
        self.excluded = self.excluded - {key} if include or not whole else self.excluded | {key}
        self.included = self.included | {key} if include and not whole else self.included - {key}

    def is_included(self, path: str, rule_id: str) -> bool:
        return (path, rule_id) in self.included or (path in self.included_sets and (path, rule_id) not in self.excluded)

    def status(self, path: str) -> str:
        ids = list(self.sets[path].docs)
        n = sum(self.is_included(path, i) for i in ids)
        return "full" if ids and n == len(ids) else "partial" if n else "none"

    def main(self) -> list[Rule]:
        """All rules of the main ruleset. A rule of several routes is several entries; ids are not merged."""
        return [r for p, s in self.sets.items() for i, rs in s.compiled.items() if self.is_included(p, i) for r in rs]

    def main_correlations(self) -> list[Correlation]:
        """Correlations of custom rulesets with a part in main, each id once."""
        out: dict[str, Correlation] = {}
        for p, s in self.sets.items():
            if not s.builtin and self.status(p) != "none":
                for c in s.correlations:
                    if self.is_included(p, c.id):
                        out.setdefault(c.id, c)
        return list(out.values())


def search_rules(rules: list[Rule], q: str = "", level: set[str] | None = None, status: set[str] | None = None, ids: set[str] | None = None, sort_by: str = "title", descending: bool = False, limit: int = 50, offset: int = 0, in_main: Callable[[Rule], bool] | None = None) -> tuple[int, list[dict]]:
    """The number of rules found, and a page of them. q is looked for in titles and descriptions, in either case."""
    word = q.lower()
    found = [r for r in rules if word in r.title.lower() or word in r.description.lower()]
    found = [r for r in found if (not level or r.level in level) and (not status or r.status in status) and (ids is None or r.id in ids)]
    key = (lambda r: (LEVELS.index(r.level), r.title)) if sort_by == "level" else (lambda r: (str(getattr(r, sort_by, "")).lower(), r.id))
    found.sort(key=key, reverse=descending)
    page = found[offset : offset + max(1, min(limit, 500))]
    return len(found), [{"id": r.id, "title": r.title, "level": r.level, "status": r.status, "tags": list(r.tags), "in_main": bool(in_main and in_main(r))} for r in page]
