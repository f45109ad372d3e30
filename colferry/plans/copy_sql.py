"""COPY statements and parquet.* table functions in SQL; everything else goes to Spark as it is."""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass, field
from typing import BinaryIO

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from colferry.errors import FerryError
from colferry.functions import host
from colferry.functions.footer import FUNCTIONS, inspect
from colferry.operators.access import ALLOW_ALL, AccessPolicy
from colferry.operators.copy_from import copy_from, copy_from_program, copy_from_stream
from colferry.operators.copy_to import copy_to, copy_to_program, copy_to_stream, select_relation
from colferry.options import is_parquet_uri
from colferry.sources.uri import parse_uri
from colferry.types import Column, Relation, of_spark

ENABLED = "colferry.enable_copy"
_TOKEN = re.compile(r"\s+|--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|[A-Za-z_]\w*|-?\d+(?:\.\d+)?|.", re.S)


@dataclass
class CopyStatement:
    direction: str
    relation: str | None = None
    query: str | None = None
    columns: list[str] | None = None
    target: str | None = None  # a uri or a command
    kind: str = "uri"  # uri, program, stdin or stdout
    options: dict[str, object] = field(default_factory=dict)
    where: str | None = None


def _tokens(text: str) -> list[tuple[str, int, int]]:
    return [(m.group(), m.start(), m.end()) for m in _TOKEN.finditer(text) if not m.group().isspace() and not m.group().startswith(("--", "/*"))]


def parse_copy(text: str) -> CopyStatement | None:
    """The statement, or None if the text is no COPY."""
    tokens = _tokens(text.strip().rstrip(";"))
    text = text.strip().rstrip(";")
    if not tokens or tokens[0][0].upper() != "COPY":
        return None
    at = 1

    def word(k: int = 0) -> str:
        return tokens[at + k][0].upper() if at + k < len(tokens) else ""

    def expect(*allowed: str) -> str:
        nonlocal at
        if word() not in allowed:
            raise FerryError(f'syntax error at or near "{tokens[at][0] if at < len(tokens) else "end of input"}"')
        at += 1
        return tokens[at - 1][0].upper()

    def name() -> str:
        nonlocal at
        token = tokens[at][0] if at < len(tokens) else ""
        if not re.fullmatch(r'"(?:[^"]|"")+"|[A-Za-z_]\w*', token):
            raise FerryError(f'syntax error at or near "{token or "end of input"}"')
        at += 1
        return token[1:-1].replace('""', '"') if token[0] == '"' else token.lower()

    def literal() -> str:
        nonlocal at
        token = tokens[at][0] if at < len(tokens) else ""
        if not token.startswith("'"):
            raise FerryError(f'syntax error at or near "{token or "end of input"}"')
        at += 1
        return token[1:-1].replace("''", "'")

    out = CopyStatement("")
    if word() == "(":
        depth, first = 0, tokens[at][2]
        while at < len(tokens):
            depth += {"(": 1, ")": -1}.get(tokens[at][0], 0)
            at += 1
            if not depth:
                break
        if depth:
            raise FerryError('syntax error at or near "end of input"')
        out.query = text[first : tokens[at - 1][1]]
    else:
        out.relation = name()
        while word() == ".":
            at += 1
            out.relation += "." + name()
        if word() == "(":
            at += 1
            out.columns = [name()]
            while expect(",", ")") == ",":
                out.columns.append(name())
    out.direction = expect("TO", "FROM").lower()
    if out.query is not None and out.direction == "from":
        raise FerryError('syntax error at or near "FROM"')
    if word() in ("STDIN", "STDOUT"):
        out.kind = expect("STDIN" if out.direction == "from" else "STDOUT").lower()
    elif word() == "PROGRAM":
        at += 1
        out.kind, out.target = "program", literal()
    else:
        out.target = literal()
    if word() == "WITH":
        at += 1
    if word() == "(":
        at += 1
        while True:
            key = name()
            if word() in (",", ")"):
                out.options[key] = "true"
            elif tokens[at][0].startswith("'"):
                out.options[key] = literal()
            else:
                value = tokens[at][0]
                at += 1
                out.options[key] = int(value) if re.fullmatch(r"-?\d+", value) else value.lower()
            if expect(",", ")") == ")":
                break
    if word() == "WHERE" and out.direction == "from":
        out.where = text[tokens[at][2] :].strip()
        at = len(tokens)
    if at < len(tokens):
        raise FerryError(f'syntax error at or near "{tokens[at][0]}"')
    return out


def is_copy_parquet(statement: CopyStatement) -> bool:
    """Whether a COPY is for Parquet: by its format option, or else by its uri's extension."""
    if "format" in statement.options:
        return statement.options["format"] == "parquet"
    if statement.kind != "uri":
        return False
    parse_uri(statement.target)
    return is_parquet_uri(statement.target)


class Session:
    """Runs SQL with COPY. Relations declared here have their own column types; others are tables and views of Spark."""

    def __init__(self, spark: SparkSession, policy: AccessPolicy = ALLOW_ALL) -> None:
        self.spark, self.policy = spark, policy
        self.relations: dict[str, Relation] = {}

    def declare(self, name: str, ddl: str, **more) -> Relation:
        """A relation for COPY, and an empty Spark view of it where there is none yet."""
        self.relations[name] = relation = Relation.of(name, ddl, **more)
        return relation

    def relation(self, name: str) -> Relation:
        if name in self.relations:
            return self.relations[name]
        if not self.spark.catalog.tableExists(name):
            raise FerryError(f'relation "{name}" does not exist')
        kind = self.spark.catalog.getTable(name).tableType
        fields = self.spark.table(name).schema
        return Relation(name, [Column(f.name, of_spark(f)) for f in fields], "view" if kind == "VIEW" else "table")

    def rows(self, name: str) -> DataFrame:
        return self.spark.table(f"`{name}`" if "." not in name else name)

    def sql(self, text: str, stdin: BinaryIO | None = None, stdout: BinaryIO | None = None) -> DataFrame | int:
        """Rows of a query; of a COPY TO the number of rows written, of a COPY FROM of rows added to the relation."""
        statement = parse_copy(text)
        if statement is None:
            return self.query(text)
        if self.spark.conf.get(ENABLED, "true").lower() not in ("true", "on"):
            raise FerryError(f"COPY is off; set {ENABLED} to true")
        if not is_copy_parquet(statement):
            if "format" in statement.options:
                raise FerryError(f"{statement.options['format']} is not a valid format. Only parquet format is supported.")
            raise FerryError("the target has no parquet extension", "Try the option (format 'parquet').")
        if statement.direction == "to":
            return self._to(statement, stdout)
        rows = self.read(statement, stdin)
        return self._add(statement.relation, rows)

    def query(self, text: str) -> DataFrame:
        """SELECT with parquet.schema('...') and its like, which become views."""

        def view(m: re.Match) -> str:
            uri = m[2][1:-1].replace("''", "'") if m[2][0] == "'" else None
            name = f"__parquet_{m[1].lower()}_{abs(hash(m[0])):x}"
            inspect(self.spark, m[1].lower(), uri, self.policy).createOrReplaceTempView(name)
            return name

        names = "|".join([*FUNCTIONS, "list"])
        call = re.compile(rf"parquet\.({names})\s*\(\s*('(?:[^']|'')*'|null)\s*\)", re.I)
        out, at = [], 0
        for token, start, end in _tokens(text):  # not within literals, quoted names and comments
            if start >= at and token.lower() == "parquet" and (m := call.match(text, start)):
                out += [text[at:start], view(m)]
                at = m.end()
        host.register(self.spark)
        return self.spark.sql(host.rewrite("".join([*out, text[at:]])))

    def guarded(self, text: str) -> DataFrame:
        """A query under the policy: of each table it names, the columns that may be read and the rows of its row policy.

        While the query is analysed, views of the tables' names hold just these. A query that gets other columns by
        them than without them reads what it may not.
        """
        if self.policy.superuser:
            return self.query(text)
        free = self.query(text)
        plan = str(self.spark._jsparkSession.sessionState().sqlParser().parsePlan(text).toString())
        named = {tuple(p.strip().strip("`") for p in m.split(",")) for m in re.findall(r"'UnresolvedRelation \[([^\]]*)\]", plan)}
        inner = set(re.findall(r"CTE \[([^\]]*)\]", plan))
        views = {n for names in inner for n in re.split(r",\s*", names)}
        restored: list = []
        touched: list[str] = []
        try:
            for parts in sorted(named):
                name = ".".join(parts)
                if len(parts) == 1 and name in views and not self.spark.catalog.tableExists(name):
                    continue
                relation, columns = self.relation(name), [f.name for f in self.rows(name).schema]
                grants = self.policy.selects
                if grants is not None and name not in grants:
                    raise FerryError(f"permission denied for table {name}")
                allowed = columns if grants is None or grants[name] is None else [c for c in columns if c in grants[name]]
                if allowed == columns and not relation.row_policy:
                    continue
                if len(parts) > 1:
                    raise FerryError(f"permission denied for table {name}", "Tables with row or column policies can be queried by their bare names alone.")
                rows = self.rows(name)
                temporary = any(t.name == name and t.isTemporary for t in self.spark.catalog.listTables())
                restored.append((name, rows if temporary else None))
                touched.append(name)
                kept = rows.where(relation.row_policy) if relation.row_policy else rows
                kept.select(*[kept[c] for c in allowed]).createOrReplaceTempView(name)
            if not touched:
                return free
            try:
                out = self.query(text)
            except AnalysisException:
                out = None
            if out is None or out.columns != free.columns:
                raise FerryError(f"permission denied for table {', '.join(touched)}")
            return out
        finally:
            for name, rows in restored:
                self.spark.catalog.dropTempView(name) if rows is None else rows.createOrReplaceTempView(name)

    def read(self, statement: CopyStatement, stdin: BinaryIO | None = None) -> DataFrame:
        """What a COPY FROM would add, lazily."""
        relation = self.relation(statement.relation)
        more = {"columns": statement.columns, "where": statement.where}
        options = {k: v for k, v in statement.options.items()}
        if statement.kind == "program":
            return copy_from_program(self.spark, relation, statement.target, options, self.policy, **more)
        if statement.kind == "stdin":
            return copy_from_stream(self.spark, relation, stdin or sys.stdin.buffer, options, self.policy, **more)
        return copy_from(self.spark, relation, statement.target, options, policy=self.policy, **more)

    def _to(self, s: CopyStatement, stdout: BinaryIO | None) -> int:
        rows = self.guarded(s.query) if s.query is not None else select_relation(self.relation(s.relation), self.rows(s.relation), s.columns, self.policy)
        if s.kind == "program":
            return copy_to_program(rows, s.target, s.options, self.policy)
        if s.kind == "stdout":
            return copy_to_stream(rows, stdout or sys.stdout.buffer, s.options)
        return copy_to(rows, s.target, s.options, self.policy)

    def _add(self, name: str, rows: DataFrame) -> int:
        """Appends to a Spark table; a declared relation without one becomes a view of the rows so far."""
        from pyspark.sql import Observation
        from pyspark.sql import functions as F

        exists = self.spark.catalog.tableExists(name)
        if exists and self.spark.catalog.getTable(name).tableType not in ("VIEW", "TEMPORARY"):
            seen = Observation()
            rows.observe(seen, F.count(F.lit(1)).alias("n")).write.insertInto(name)
            return int(seen.get["n"])
        if name not in self.relations:
            raise FerryError(f'cannot copy to view "{name}"')
        n = rows.count()
        (self.rows(name).unionAll(rows) if exists else rows).createOrReplaceTempView(name)
        return n


def copy_sql(spark: SparkSession, text: str, **more) -> DataFrame | int:
    return Session(spark).sql(text, **more)
