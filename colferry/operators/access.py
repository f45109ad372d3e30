"""Who may copy what: a policy object, which allows all by default."""

from __future__ import annotations

from dataclasses import dataclass, field

from colferry.errors import FerryError
from colferry.sources.uri import Uri

ROLES = ("program", "file_read", "file_write", "object_read", "object_write")


@dataclass(frozen=True)
class AccessPolicy:
    """superuser passes everything; else roles of ROLES are needed for targets, and the tables' own grants.

    selects and inserts: table -> columns that may be read or written (None: all), or absent tables: none. Left out
    altogether, all tables may be. allow_programs: shell commands run only where this is set.
    """

    superuser: bool = True
    roles: frozenset[str] = frozenset()
    selects: dict[str, frozenset[str] | None] | None = field(default=None, hash=False)
    inserts: dict[str, frozenset[str] | None] | None = field(default=None, hash=False)
    allow_programs: bool = False

    def check_target(self, direction: str, uri: Uri | None = None, program: bool = False) -> None:
        """direction: to or from. Streams of the client need no role."""
        if program and not self.allow_programs or not self.superuser and (program or uri):
            write = direction == "to"
            need = "program" if program else ("object_" if uri.remote else "file_") + ("write" if write else "read")
            if program and not self.allow_programs or need not in self.roles:
                what = "program" if program else "remote uri" if uri.remote else "file"
                raise FerryError(f"permission denied to COPY {direction} a {what}", f"Only roles with {need} may COPY {direction} a {what}.")

    def check_table(self, direction: str, table: str, columns: list[str]) -> None:
        grants = self.inserts if direction == "from" else self.selects
        if self.superuser or grants is None:
            return
        if table not in grants or grants[table] is not None and not set(columns) <= grants[table]:
            raise FerryError(f"permission denied for table {table}")


ALLOW_ALL = AccessPolicy(allow_programs=True)
