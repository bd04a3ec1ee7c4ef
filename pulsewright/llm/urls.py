"""URL filters: many wildcard patterns run at once over each canonical URL, bit-parallel.

A URL is canonical as host (A-Z lowered) followed by path, without scheme, query and fragment. Every pattern is a row
of bits in a few 64-bit words: one start bit, then one bit for each of its characters. A step over one byte is
``((D << 1) & B[byte]) | (D & S[byte])``: B lets a character in, S holds a bit where a wildcard can stay. All URLs of a
batch advance together, and all patterns advance in every URL, so the cost doesn't depend on the number of patterns
beyond one machine word for each 64 characters.

In a pattern ``?`` is one character other than ``/``, ``*`` any run of such characters, ``**`` any run at all.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path) of the site rules: a rule fits its host and all subdomains where the path starts with its path.
SITE_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

#: (verdict, pattern) for URLs that no site rule fits. A blocking pattern wins over an allowing one; none fits: allow.
DEFAULT_GLOBS = (
    ("block", "*spam*/**"),
    ("block", "*spam*"),
    ("block", "*cheap-pills*/**"),
    ("block", "*cheap-pills*"),
    ("block", "*casino*/**"),
    ("block", "*casino*"),
    ("block", "**/wp-admin/**"),
    ("block", "**/login*"),
    ("block", "**.exe"),
    ("allow", "**/robots.txt"),
)

CELLS = 4_000_000


class WildcardSet:
    """Patterns packed into masks; ``match`` tells for each URL which of them fit it from end to end."""

    def __init__(self, patterns: Sequence[str]):
        self.patterns = list(patterns)
        bits: list[tuple[bytes | None, str]] = []  # per bit: its character (None: start), and the wildcard that may stay
        self.start, self.last = [], []
        for pattern in self.patterns:
            self.start.append(len(bits))
            bits.append((None, ""))
            for unit in self._units(pattern):
                if unit in ("*", "**"):
                    char, stays = bits[-1]
                    bits[-1] = (char, max(stays, unit, key=len))
                else:
                    bits.append((unit, ""))
            self.last.append(len(bits) - 1)
        self.words = max(1, -(-len(bits) // 64))
        self.enter = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        slash = ord("/")
        for k, (char, stays) in enumerate(bits):
            word, bit = k // 64, np.uint64(1 << (k % 64))
            if char == b"?":
                self.enter[:, word] |= bit
                self.enter[slash, word] &= ~bit
            elif char is not None:
                self.enter[char[0], word] |= bit
            if stays:
                self.stay[:, word] |= bit
                if stays == "*":
                    self.stay[slash, word] &= ~bit
        self.first = np.zeros(self.words, np.uint64)
        for k in self.start:
            self.first[k // 64] |= np.uint64(1 << (k % 64))

    @staticmethod
    def _units(pattern: str):
        data, k = pattern.encode(), 0
        while k < len(data):
            if data[k : k + 2] == b"**":
                yield "**"
                k += 2
            elif data[k : k + 1] == b"*":
                yield "*"
                k += 1
            else:
                yield data[k : k + 1]
                k += 1

    def match(self, urls: Sequence[bytes]) -> np.ndarray:
        """A boolean row for each URL, a column for each pattern."""
        out = np.zeros((len(urls), len(self.patterns)), bool)
        lengths = np.fromiter(map(len, urls), np.int64, len(urls))
        order = np.argsort(-lengths, kind="stable")
        at = 0
        while at < len(order):
            longest = max(1, int(lengths[order[at]]))
            part = order[at : at + max(1, CELLS // longest)]
            out[part] = self._run([urls[k] for k in part], lengths[part])
            at += len(part)
        return out

    def _run(self, urls: list[bytes], lengths: np.ndarray) -> np.ndarray:
        """URLs come longest first, so those still running are a prefix."""
        width = int(lengths[0])
        cells = np.frombuffer(b"".join(u.ljust(width, b"\0") for u in urls), np.uint8).reshape(len(urls), width)
        state = np.repeat(self.first[None, :], len(urls), axis=0)
        one, top = np.uint64(1), np.uint64(63)
        running = np.searchsorted(-lengths, -np.arange(width), side="left")
        for step in range(width):
            n = running[step]
            d, byte = state[:n], cells[:n, step]
            moved = d << one
            moved[:, 1:] |= d[:, :-1] >> top
            state[:n] = (moved & self.enter[byte]) | (d & self.stay[byte])
        columns = [(state[:, k // 64] >> np.uint64(k % 64)) & one for k in self.last]
        return np.stack(columns, axis=1).astype(bool) if columns else np.zeros((len(urls), 0), bool)


def filter_urls(
    pages: DataFrame,
    site_rules: Sequence[tuple[str, str, str]] = SITE_RULES,
    globs: Sequence[tuple[str, str]] = DEFAULT_GLOBS,
) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages`` (page_id, url, more columns are ignored).

    The longest site rule that fits gives rule and verdict. Without one, rule is null and the patterns decide: block if
    a blocking one fits, else allow. A null URL or one without ``://`` has an empty host and path, which only patterns
    that match the empty string fit. Repeated rows are judged each on its own; an empty table gives an empty result.
    """
    ranked = sorted(site_rules, key=lambda r: -len(r[1] + r[2]))
    site = [g for _, host, path in ranked for g in (f"{host}{path}**", f"*.{host}{path}**")]
    automaton = WildcardSet([*site, *(g for _, g in globs)])
    blocks = np.array([v == "block" for v, _ in globs], bool)
    names = pa.array([f"{host}{path}" for _, host, path in ranked] + [None], pa.string())
    verdicts = np.array([v for v, _, _ in ranked] + [""], object)
    schema = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])

    def judge(batches):
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            fits = automaton.match([(h + p).encode() for h, p in zip(hosts, paths, strict=True)])
            of_site = fits[:, : len(site)].reshape(len(hosts), len(ranked), 2).any(axis=2)
            chosen = np.where(of_site.any(axis=1), of_site.argmax(axis=1), len(ranked)) if ranked else np.zeros(len(hosts), int)
            blocked = (fits[:, len(site) :] & blocks).any(axis=1)
            verdict = np.where(chosen < len(ranked), verdicts[chosen], np.where(blocked, "block", "allow"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), names.take(pa.array(chosen)), pa.array(verdict, pa.string())], schema=schema
            )

    rest = F.when(F.contains("u", F.lit("://")), F.expr("substr(u, instr(u, '://') + 3)")).otherwise("")
    parts = (
        pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("u"))
        .select("page_id", rest.alias("rest"))
        .select(
            "page_id",
            F.translate(F.regexp_extract("rest", r"^[^/?#]*", 0), UPPER, LOWER).alias("host"),
            F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"),
        )
    )
    return parts.mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string")


def oracle(site_rules: Sequence[tuple[str, str, str]] = SITE_RULES) -> str:
    """DuckDB SQL for the rows of ``filter_urls`` under the default patterns."""
    ranked = sorted(site_rules, key=lambda r: -len(r[1] + r[2]))
    fits = lambda host, path: f"(host = '{host}' or host like '%.{host}') and starts_with(path, '{path}')"
    rule = " ".join(f"when {fits(h, p)} then '{h}{p}'" for _, h, p in ranked)
    verdict = " ".join(f"when {fits(h, p)} then '{v}'" for v, h, p in ranked)
    blocked = (
        "host like '%spam%' or host like '%cheap-pills%' or host like '%casino%' "
        "or host || path like '%/wp-admin/%' or regexp_matches(host || path, '/login[^/]*$') or host || path like '%.exe'"
    )
    return f"""
    with parts as (
      select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
    ), split as (
      select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') as host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from parts
    )
    select page_id, host, path, case {rule} end as rule,
           case {verdict} when {blocked} then 'block' else 'allow' end as verdict
    from split"""
