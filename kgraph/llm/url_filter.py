"""URL filters by a bit-parallel wildcard automaton.

Glob rules are packed into one multiword Shift-And automaton: every symbol of every rule is one bit, every rule
starts with one bit for "nothing read yet". One step over a byte c is

    state = ((state << 1) & ACCEPT[c]) | (state & LOOP[c])

for all rules at once, with the carry handed from word to word. A bit loops where a star follows it. The state
is kept for all URLs of an Arrow batch side by side, so a step is a few numpy operations. The work is a scan:
no shuffle, and what is sent to the tasks is the rule list.

Globs: `*` any run without `/`, `**` any run, `?` one byte other than `/`, a backslash quotes the next character.
A rule matches a whole canonical URL: host with A-Z lower-cased, then path, without scheme, query and fragment.

Defined cases: a null URL or one without `://` has an empty host and path and is matched as the empty text;
repeated rows are judged alike; an empty table gives an empty result; input columns named like an output
column are replaced by it.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgraph.llm.common import quoted, small_batches, table, without

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OUTPUTS = ["host", "path", "rule", "verdict"]


class Site(NamedTuple):
    """A host with all its subdomains and a literal start of the path."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Rules of the registered query; the longest that fits a URL decides.
SITES = (
    Site("org", "/", "allow"),
    Site("example.org", "/es/", "block"),
    Site("example.org", "/en/1", "block"),
    Site("com", "/fr/", "allow"),
    Site("com", "/de/", "block"),
)
#: Globs that block a URL for which no site rule decides. Everything else is allowed.
BLOCK_GLOBS = (
    "*spam-farm*", "*spam-farm*/**", "*casino*", "*casino*/**", "**/wp-login.php", "**/cgi-bin/**",
    "**.exe", "**.zip", "**/tag/*/page/**", "**/*=*=*=*",
)


def quote(text: str) -> str:
    """A glob that matches `text` alone."""
    return "".join("\\" + c if c in "*?\\" else c for c in text)


def symbols(glob: str) -> list[int | str]:
    """A glob as byte values and the marks `?`, `*` and `**`."""
    out: list[int | str] = []
    i = 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            run = len(glob[i:]) - len(glob[i:].lstrip("*"))
            out.append("**" if run > 1 else "*")
            i += run
            continue
        if c == "\\" and i + 1 < len(glob):
            i += 1
            out.extend(glob[i].encode())
        elif c == "?":
            out.append("?")
        else:
            out.extend(c.encode())
        i += 1
    return out


class Automaton:
    """Globs packed into 64-bit words; `match` runs them over many byte strings at once."""

    def __init__(self, globs: Sequence[str]):
        parsed = [symbols(g) for g in globs]
        width = sum(1 + sum(not (isinstance(s, str) and s[0] == "*") for s in p) for p in parsed)
        self.words = max(1, -(-width // 64))
        accept = np.zeros((256, self.words * 64), bool)
        loop = np.zeros((256, self.words * 64), bool)
        start = np.zeros(self.words * 64, bool)
        self.final = np.zeros(len(globs), np.int64)
        bit = -1
        for k, parts in enumerate(parsed):
            bit += 1
            start[bit] = True
            for s in parts:
                if s in ("*", "**"):
                    loop[:, bit] = True
                    loop[ord("/"), bit] = s == "**"
                    continue
                bit += 1
                if s == "?":
                    accept[:, bit] = True
                    accept[ord("/"), bit] = False
                else:
                    accept[s, bit] = True
            self.final[k] = bit
        self.accept, self.loop, self.start = self._pack(accept), self._pack(loop), self._pack(start[None])[0]

    @staticmethod
    def _pack(bits: np.ndarray) -> np.ndarray:
        return np.packbits(bits, axis=1, bitorder="little").view("<u8").astype(np.uint64)

    def match(self, texts: Sequence[bytes]) -> np.ndarray:
        """Booleans, a row for each text and a column for each glob."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-sizes, kind="stable")
        data = np.frombuffer(b"".join(texts), np.uint8)
        begins = (np.cumsum(sizes) - sizes)[order]
        # texts by falling length: those longer than j are the first left[j]
        left = len(texts) - np.searchsorted(np.sort(sizes), np.arange(sizes.max(initial=0)), side="right")
        state = np.tile(self.start, (len(texts), 1))
        for j, n in enumerate(left):
            now = state[:n]
            c = data[begins[:n] + j]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:n] = (moved & self.accept[c]) | (now & self.loop[c])
        hit = (state[:, self.final // 64] >> (self.final % 64).astype(np.uint64)) & np.uint64(1)
        out = np.empty(hit.shape, bool)
        out[order] = hit.astype(bool)
        return out


def canonical(df: DataFrame, url: str = "url") -> DataFrame:
    """`df` with `host` and `path`."""
    rest = F.when(F.col(url).contains("://"), F.expr(f"substr(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))
    kept = quoted(without(df, ["host", "path"]))
    parts = df.select(*kept, rest.alias("__rest")).withColumn("host", F.regexp_extract("__rest", "^[^/?#]*", 0))
    return parts.select(
        *kept, F.translate("host", UPPER, UPPER.lower()).alias("host"),
        F.regexp_extract(F.expr("substr(__rest, length(host) + 1)"), "^[^?#]*", 0).alias("path"),
    )


def judge_urls(
    df: DataFrame, url: str = "url", sites: Sequence[Site] = SITES, block_globs: Sequence[str] = BLOCK_GLOBS,
) -> DataFrame:
    """`df` with `host`, `path`, the deciding site `rule` and `verdict`.

    Of the site rules that fit, the one with the longest name decides, and of equally long ones the first. Without
    one, a matching block glob blocks and everything else is allowed.
    """
    small_batches(df.sparkSession, rows=8192)
    ranked = sorted(sites, key=lambda s: -len(s.name))
    globs = [g for s in ranked for g in (quote(s.name) + "**", "*." + quote(s.name) + "**")]
    automaton = Automaton([*globs, *block_globs])
    names, verdicts = [s.name for s in ranked], [s.verdict for s in ranked]

    @F.arrow_udf("struct<rule: string, verdict: string>")
    def judged(urls: pa.Array) -> pa.Array:
        hits = automaton.match([u.encode() for u in urls.to_pylist()])
        fits = hits[:, :len(globs)].reshape(len(hits), -1, 2).any(axis=2)
        first = np.where(fits.any(axis=1), fits.argmax(axis=1) if len(names) else 0, -1)
        blocked = hits[:, len(globs):].any(axis=1)
        return pa.StructArray.from_arrays([
            pa.array([names[k] if k >= 0 else None for k in first], pa.string()),
            pa.array([verdicts[k] if k >= 0 else ("block" if b else "allow") for k, b in zip(first, blocked)], pa.string()),
        ], ["rule", "verdict"])

    parts = canonical(df, url)
    kept = quoted(without(parts, OUTPUTS))
    return parts.select(*kept, "host", "path", judged(F.concat("host", "path")).alias("__judged")).select(
        *kept, "host", "path", "__judged.rule", "__judged.verdict")


def op8_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    """The verdict on every page's URL."""
    return judge_urls(table(spark, folder, "pages").select("page_id", "url")).select(
        "page_id", "host", "path", "rule", "verdict")


def _sql_glob(glob: str) -> str:
    """A glob as a regular expression of the check SQL."""
    out = ""
    for s in symbols(glob):
        out += {"*": "[^/]*", "**": ".*", "?": "[^/]"}[s] if isinstance(s, str) else f"\\x{s:02x}"
    return f"regexp_full_match(host || path, '(?s){out}')"


def _sql_fits(site: Site) -> str:
    return f"(host = '{site.host}' OR ends_with(host, '.{site.host}')) AND starts_with(path, '{site.path}')"


_RANKED = sorted(SITES, key=lambda s: -len(s.name))
OP8_SQL = f"""
WITH rest AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM rest),
parts AS (
  SELECT page_id, translate(raw, '{UPPER}', '{UPPER.lower()}') AS host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM hosts)
SELECT page_id, host, path,
  CASE {" ".join(f"WHEN {_sql_fits(s)} THEN '{s.name}'" for s in _RANKED)} END AS rule,
  CASE {" ".join(f"WHEN {_sql_fits(s)} THEN '{s.verdict}'" for s in _RANKED)}
    WHEN {" OR ".join(map(_sql_glob, BLOCK_GLOBS))} THEN 'block' ELSE 'allow' END AS verdict
FROM parts
"""

QUERIES = {"op8_url_rules": (op8_url_rules, OP8_SQL)}
