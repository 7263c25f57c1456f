"""Names with many spellings, found in titles by one automaton for all of them.

A table of names is data: for each name its spellings, whether its whole catalogue is in the wanted scale, whether the name is a common
word elsewhere, and whether it may stand within a longer word. Titles and spellings are squeezed, with white space left out, so that
`two words`, `two  words` and `twowords` are one spelling; a match counts if the title has white space only where the spelling has. A title
costs what its length and matches cost, however many names there are. The table goes to all tasks, so its size is checked; a table of any
size is a DataFrame, and `joined` matches by a join on what stands between the bounds of words."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text

#: Most spellings of a table.
MOST = 100_000
_SPACE = re.compile(r"\s+")
_FOUND = "array<struct<at:int,place:int,name:string>>"


@dataclass(frozen=True)
class Name:
    name: str
    spellings: tuple[str, ...] = ()
    native: bool = False
    common: bool = False
    inside: bool = False

    def all(self) -> tuple[str, ...]:
        return self.spellings or (self.name,)


def _squeezed(s: str) -> tuple[str, list[int]]:
    """s in lower case without white space, and where each of its characters stands in s."""
    kept = [(c.lower() if len(c.lower()) == 1 else c, k) for k, c in enumerate(s) if not c.isspace()]
    return "".join(c for c, _ in kept), [k for _, k in kept]


def _word(c: str) -> bool:
    return c == "_" or (c.isascii() and c.isalnum())


class Matcher:
    """The automaton of a table of names."""

    def __init__(self, names: Sequence[Name]):
        self.names, spelled = names, {}
        for place, n in enumerate(names):
            for s in n.all():
                key, at = _squeezed(s.strip())
                if not key:
                    raise ValueError(f"{n.name}: a spelling without a letter")
                gaps = frozenset(k for k in range(1, len(at)) if at[k] > at[k - 1] + 1)
                spelled.setdefault(key, []).append((place, gaps, not n.inside))
        if sum(map(len, spelled.values())) > MOST:
            raise ValueError(f"more than {MOST} spellings")
        self.automaton = ahocorasick.Automaton()
        for key, what in spelled.items():
            self.automaton.add_word(key, (len(key), what))
        self.automaton.make_automaton()

    def find(self, title: str | None) -> list[tuple[int, int]]:
        """(at, place) of the first match of each name, by offset from 0 and then by the order of the table."""
        if not title or not self.names:
            return []
        key, at = _squeezed(title)
        first: dict[int, int] = {}
        for end, (size, what) in self.automaton.iter(key):
            start = end - size + 1
            apart = {k - start for k in range(start + 1, end + 1) if at[k] > at[k - 1] + 1}
            lo, hi = at[start], at[end] + 1
            whole = None
            for place, gaps, bounded in what:
                if not apart <= gaps or first.get(place, lo + 1) <= lo:
                    continue
                if bounded:
                    if whole is None:
                        whole = not (lo > 0 and _word(title[lo - 1]) and _word(title[lo])) and not (hi < len(title) and _word(title[hi]) and _word(title[hi - 1]))
                    if not whole:
                        continue
                first[place] = lo
        return sorted((lo, place) for place, lo in first.items())


@lru_cache(8)
def matcher(names: tuple[Name, ...]) -> Matcher:
    return Matcher(names)


def found(title: Column, names: Sequence[Name]) -> Column:
    """An array of (at, place, name): the names in a title, by their first offsets (from 0). Empty for a null title."""
    names = tuple(names)
    matcher(names)  # a table that is too large, or broken, is refused here

    @F.arrow_udf(_FOUND)
    def find(titles: pa.Array) -> pa.Array:
        m = matcher(names)
        rows = [[{"at": at, "place": place, "name": names[place].name} for at, place in m.find(t)] for t in titles.to_pylist()]
        return pa.array(rows, pa.list_(pa.struct([("at", pa.int32()), ("place", pa.int32()), ("name", pa.string())])))

    return find(title)


def _bounded(title: str, lo: int, hi: int) -> tuple[bool, bool]:
    """Whether words end at both ends of title[lo:hi]."""
    return not (lo > 0 and _word(title[lo - 1]) and _word(title[lo])), not (hi < len(title) and _word(title[hi]) and _word(title[hi - 1]))


_PIECE = "array<struct<key:string,at:int,bounded:boolean,gaps:array<int>>>"


def _pieces(sizes: list[int], anywhere: list[int]):
    """A column function from titles to their squeezed pieces of such sizes; of sizes in `anywhere`, those within words as well."""

    def of(title: str | None) -> list[dict]:
        key, at = _squeezed(title or "")
        out = []
        for start, lo in enumerate(at):
            begins = _bounded(title, lo, lo + 1)[0]
            for size in sizes if begins else anywhere:
                end = start + size
                if end > len(key):
                    break
                bounded = begins and _bounded(title, lo, at[end - 1] + 1)[1]
                if bounded or size in inside:
                    out.append({"key": key[start:end], "at": lo, "bounded": bounded, "gaps": [k - start for k in range(start + 1, end) if at[k] > at[k - 1] + 1]})
        return out

    inside = frozenset(anywhere)
    kind = pa.list_(pa.struct([("key", pa.string()), ("at", pa.int32()), ("bounded", pa.bool_()), ("gaps", pa.list_(pa.int32()))]))

    @F.arrow_udf(_PIECE)
    def cut(titles: pa.Array) -> pa.Array:
        return pa.array([of(t) for t in titles.to_pylist()], kind)

    return cut


def _spelled(spelling: Column) -> Column:
    """A spelling squeezed, and where it has white space."""

    @F.arrow_udf("struct<key:string,gaps:array<int>>")
    def squeeze(spellings: pa.Array) -> pa.Array:
        out = []
        for s in spellings.to_pylist():
            key, at = _squeezed((s or "").strip())
            out.append({"key": key, "gaps": [k for k in range(1, len(at)) if at[k] > at[k - 1] + 1]})
        return pa.array(out, pa.struct([("key", pa.string()), ("gaps", pa.list_(pa.int32()))]))

    return squeeze(spelling)


def joined(rows: DataFrame, title: str, table: DataFrame) -> DataFrame:
    """rows with a column `found`, as `found` gives it, for a table of names of any size.

    table(place long, name, spelling, inside boolean): a row a spelling. Nothing of it but the lengths of its spellings goes through the
    driver. Pieces of titles that have such a length meet the spellings by a shuffle; those of names that stand as words of their own
    begin and end where words do, so they are few. A spelling without a letter matches nothing."""
    own = rows.columns
    spellings = table.withColumn("_s", _spelled(F.col("spelling"))).select("place", "name", F.coalesce("inside", F.lit(False)).alias("inside"), "_s.key", F.col("_s.gaps").alias("may")).filter("key <> ''")
    lengths = [tuple(r) for r in spellings.select(F.length("key").alias("n"), "inside").distinct().collect()]  # as many as the longest name has letters, at most, twice
    sizes, anywhere = sorted({n for n, _ in lengths}), sorted({n for n, inside in lengths if inside})
    cut = rows.select(F.monotonically_increasing_id().alias("_id"), F.struct(*own).alias("_row"), _pieces(sizes, anywhere)(F.col(title)).alias("_pieces"))
    pieces = cut.select("_id", F.explode("_pieces").alias("p")).select("_id", "p.*")
    fits = (F.col("inside") | F.col("bounded")) & (F.size(F.array_except("gaps", "may")) == 0)
    met = pieces.join(spellings, "key").filter(fits).groupBy("_id", "place").agg(F.min("at").alias("at"), F.min("name").alias("name"))
    told = met.groupBy("_id").agg(F.sort_array(F.collect_list(F.struct("at", "place", "name"))).alias("found"))
    out = cut.select("_id", "_row").join(told, "_id", "left")
    return out.select("_row.*", F.coalesce("found", F.array().cast("array<struct<at:int,place:bigint,name:string>>")).alias("found"))


def in_order(at: Column) -> Column:
    """The names of what was found, by their order in the table."""
    return F.transform(F.array_sort(F.transform(at, lambda x: F.struct(x["place"], x["name"]))), lambda x: x["name"])


def listed(title: Column, names: Sequence[Name]) -> Column:
    """The names in a title, by their order in the table."""
    return in_order(found(title, names))


def brand(title: Column, names: Sequence[Name], pack: text.RulePack = text.RulePack(), latest: int = 35, hint: Column | None = None) -> Column:
    """The brand named first, by the rules of `text.brand`; a seller's own field counts by the first of its names in the table's order."""
    return brand_of(title, found(title, names), [n.name for n in names if n.common], pack, latest, None if hint is None else listed(hint, names))


def brand_of(title: Column, at: Column, common: Sequence[str] = (), pack: text.RulePack = text.RulePack(), latest: int = 35, hinted: Column | None = None) -> Column:
    """The brand of a title with names found at `at`; hinted: the names in the seller's own field, in the table's order."""
    first = F.get(at, F.lit(0))
    proper = F.coalesce(~F.lower(title).rlike(pack.knockoffs) & ~F.lower(title).rlike(pack.accessories), F.lit(True))
    sure = (F.size(at) < 3) & (first["at"] <= latest)
    if common:
        sure = sure & (~first["name"].isin(*common) | F.lower(title).rlike(pack.vehicles))
    told = F.when((F.size(at) > 0) & sure, first["name"])
    if hinted is not None:
        told = F.when(F.size(at) == 0, F.get(hinted, F.lit(0))).otherwise(told)
    return F.when(proper, told)


def wanted(title: Column, names: Sequence[Name], pack: text.RulePack = text.RulePack(), hint: Column | None = None) -> Column:
    """Whether a title is of a brand of the table in a wanted scale, or of a native one that states no scale."""
    b, s = brand(title, names, pack, hint=hint), text.scales(title)
    native = [n.name for n in names if n.native]
    fits = F.exists(s, lambda n: n.between(*pack.scales)) | ((F.size(s) == 0) & (b.isin(*native) if native else F.lit(False)))
    return b.isNotNull() & F.coalesce(fits, F.lit(False))
