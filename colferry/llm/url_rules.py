"""URL filter: host and path rules and glob rules, run as one bit-parallel automaton.

Each glob becomes a run of bits in a multiword Shift-And mask; one pass over a URL moves all globs at once, and a
batch of URLs moves in step, so the work is (longest URL) x (words of the mask), whatever the number of URLs.
In a glob `?` is one byte but `/`, `*` a run without `/`, `**` any run, all else itself; a glob fits a whole string.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from colferry.llm.common import small_batches

#: (rule, verdict): host, then the path's beginning. A rule fits its host and all subdomains.
HOST_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Globs over the canonical URL that block where no host rule decides.
GLOB_BLOCK = (
    "*://*spam-farm*/**", "*://*cheap-pills*/**", "*://*casino*/**", "*://*porn*/**", "*://*xxx*/**",
    "**/wp-login.php**", "**/cgi-bin/**", "**.exe", "**/search?**", "**/cart/**", "**/checkout/**",
)
CELLS = 4 << 20


class WildcardAutomaton:
    """All globs as one Shift-And automaton over bytes."""

    def __init__(self, globs: Sequence[str]) -> None:
        moves: list[list] = []
        for glob in globs:
            tokens: list = []
            data, i = glob.encode(), 0
            while i < len(data):
                if data[i : i + 2] == b"**":
                    tokens.append("**")
                    i += 2
                    continue
                tokens.append({42: "*", 63: "?"}.get(data[i], data[i]))
                i += 1
            moves.append(tokens)
        bits = sum(1 + sum(t not in ("*", "**") for t in tokens) for tokens in moves)
        self.words = max(1, -(-bits // 64))
        self.step = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        self.final: list[tuple[int, np.uint64]] = []
        at, short, whole = 0, set(), set()  # bits that stay on all bytes but a slash; on all
        for tokens in moves:
            self.start[at // 64] |= np.uint64(1 << at % 64)
            for t in tokens:
                if t in ("*", "**"):
                    (short if t == "*" else whole).add(at)
                    continue
                at += 1
                chars = [c for c in range(256) if c != 47] if t == "?" else [t]
                self.step[chars, at // 64] |= np.uint64(1 << at % 64)
            self.final.append((at // 64, np.uint64(1 << at % 64)))
            at += 1
        for bit in short | whole:
            self.stay[:, bit // 64] |= np.uint64(1 << bit % 64)
        for bit in short - whole:
            self.stay[47, bit // 64] &= ~np.uint64(1 << bit % 64)

    def run(self, strings: Sequence[bytes]) -> np.ndarray:
        """A boolean for each string (row) and glob (column)."""
        out = np.zeros((len(strings), len(self.final)), bool)
        lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        order = np.argsort(-lengths, kind="stable")
        at = 0
        while at < len(order):
            width = max(1, int(lengths[order[at]]))
            rows = order[at : at + max(1, CELLS // width)]
            at += len(rows)
            chars = np.zeros((len(rows), width), np.uint8)
            for k, r in enumerate(rows):
                chars[k, : lengths[r]] = np.frombuffer(strings[r], np.uint8)
            live = np.tile(self.start, (len(rows), 1))
            ends = lengths[rows]
            for i in range(width):
                n = int(np.searchsorted(-ends, -i, "left"))  # rows longer than i
                c, d = chars[:n, i], live[:n]
                moved = d << np.uint64(1)
                moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
                live[:n] = (moved & self.step[c]) | (d & self.stay[c])
            for g, (word, bit) in enumerate(self.final):
                out[rows, g] = (live[:, word] & bit) != 0
        return out


def host_path(url: str | None) -> tuple[str, str]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end; path: from there up to `?`, `#` or the end."""
    if url is None or (i := url.find("://")) < 0:
        return "", ""
    rest = url[i + 3 :]
    end = min((k for k in map(rest.find, "?#") if k >= 0), default=len(rest))
    rest = rest[:end]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return host.encode().lower().decode(), path  # bytes.lower: A-Z only


def canonical(url: str | None) -> bytes:
    """Scheme and host in lower case, no fragment, no utm_ parameters, other bytes than ASCII as %XX."""
    if url is None or (i := url.find("://")) < 0:
        return b""
    host, path = host_path(url)
    query = url[i + 3 :].partition("#")[0].partition("?")[2]
    query = "&".join(x for x in query.split("&") if x and not x.startswith("utm_"))
    whole = f"{url[:i].lower()}://{host}{path or '/'}" + (f"?{query}" if query else "")
    return quote(whole, safe="".join(map(chr, range(33, 127)))).encode()


def judge_urls(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", host_rules: Sequence[tuple[str, str]] = HOST_RULES, glob_block: Sequence[str] = GLOB_BLOCK
) -> DataFrame:
    """page_id, host, path, rule, verdict, glob: the longest fitting host rule decides, else the globs.

    Null or no `://`: host and path are empty and no rule or glob fits, so the verdict is allow. A null id stays null;
    repeated rows are judged each; an empty table gives none; other columns are not read. URLs may be of any length.
    """
    ranked = sorted(host_rules, key=lambda r: (-len(r[0]), r[0]))
    of_hosts = [g for rule, _ in ranked for g in (f"{rule}**", f"*.{rule}**")]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hosts, globs = WildcardAutomaton(of_hosts), WildcardAutomaton(glob_block)
        for batch in batches:
            urls = batch.column(1).to_pylist()
            parts = [host_path(u) for u in urls]
            fits = hosts.run([(h + p).encode() for h, p in parts]).reshape(len(urls), -1, 2).any(2)
            first = np.where(fits.any(1), fits.argmax(1), -1) if len(ranked) else np.full(len(urls), -1)
            hit = globs.run([canonical(u) for u in urls])
            bad = np.where(hit.any(1), hit.argmax(1), -1) if len(glob_block) else np.full(len(urls), -1)
            rule = [ranked[k][0] if k >= 0 else None for k in first]
            verdict = [ranked[k][1] if k >= 0 else "block" if g >= 0 else "allow" for k, g in zip(first, bad)]
            glob = [glob_block[g] if g >= 0 else None for g in bad]
            cols = [batch.column(0), pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string())]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array(x, pa.string()) for x in (rule, verdict, glob))], names=names)

    src = small_batches(pages).select(pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("url"))
    names = ["page_id", "host", "path", "rule", "verdict", "glob"]
    return src.mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string, glob string")
