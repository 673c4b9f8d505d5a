"""Places of pattern matches in texts, by SQL functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Matches that are folded together.
PART = 256
SPAN = "array<struct<start:int,nth:int,kind:string,end:int,match:string>>"


def found(text: Column, pattern: str, kind: str, nth: int, keep=None) -> Column:
    """array<struct<start, nth, kind, end, match>> of the leftmost non-overlapping matches, in code points.

    The pieces between the matches (split) and the matches (regexp_extract_all) come from the same
    scan rule, so their lengths give every start. keep: what a match must satisfy; the others go.
    Null text has no matches.
    """
    none = F.array().cast(SPAN)

    def build(pieces: Column) -> Column:
        gaps, matches = pieces["g"], pieces["m"]
        zero = F.struct(F.lit(0).alias("at"), none.alias("out"))

        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + F.length(x["gap"])
            end = start + F.length(x["match"])
            one = F.array(F.struct(start.alias("start"), F.lit(nth).alias("nth"), F.lit(kind).alias("kind"), end.alias("end"), x["match"].alias("match")))
            return F.struct(end.alias("at"), (F.concat(acc["out"], one) if keep is None else F.when(keep(x["match"]), F.concat(acc["out"], one)).otherwise(acc["out"])).alias("out"))

        def shifted(s: Column, by: Column) -> Column:
            return F.struct((s["start"] + by).alias("start"), s["nth"].alias("nth"), s["kind"].alias("kind"), (s["end"] + by).alias("end"), s["match"].alias("match"))

        pairs = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
        # a fold copies its result at each step: parts of PART matches are folded by themselves, then moved to where they begin
        parts = F.transform(F.array(pairs), lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / PART).cast("int")), lambda i: F.aggregate(F.slice(p, i * PART + 1, F.lit(PART)), zero, step)))
        parts = F.element_at(parts, 1)

        def joined(p: Column) -> Column:
            begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
            starts = F.aggregate(p, begin, lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
            return F.flatten(F.zip_with(p, starts, lambda x, at: F.transform(x["out"], lambda s: shifted(s, at))))

        return F.element_at(F.transform(F.array(parts), lambda p: F.when(F.size(p) == 1, p[0]["out"]).otherwise(joined(p))), 1)

    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # bound once by a lambda, so that the text is scanned once for each
    bound = F.transform(F.array(matches), lambda m: F.when(F.size(m) > 0, build(F.struct(F.split(text, pattern, -1).alias("g"), m.alias("m")))).otherwise(none))
    return F.coalesce(F.element_at(bound, 1), none)


def listed(spans: Column) -> Column:
    """kind:start:end of spans by start, then kind as listed, comma-joined."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["nth"], s["end"], s["kind"])))
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def masked_text(text: Column, spans: Column, mark: str) -> Column:
    """The text with each maximal run of spans replaced by mark."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))

    def runs(o: Column) -> Column:
        """Maximal runs as (start, end), by parts: the spans of a part are joined, then the parts' runs."""
        none = F.array().cast("array<struct<start:int,end:int>>")

        def step(acc: Column, s: Column) -> Column:
            last = F.try_element_at(acc, F.lit(-1))
            apart = F.size(acc) == 0
            apart = apart | (s["start"] > last["end"])
            longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
            return F.when(apart, F.concat(acc, F.array(s))).otherwise(F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(longer)))

        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(o) - 1) / PART).cast("int")), lambda i: F.aggregate(F.slice(o, i * PART + 1, F.lit(PART)), none, step))
        return F.when(F.size(o) == 0, none).otherwise(F.flatten(parts))

    def cut(r: Column) -> Column:
        """The texts between the runs, each behind the end of the run before, with the mark where a run begins anew. A substring is sought from its text's beginning: each part of the runs is sought in its own stretch."""
        ends = F.concat(F.array(F.lit(0)), F.transform(r, lambda x: x["end"]))
        pairs = F.zip_with(r, F.slice(ends, 1, F.size(r)), lambda x, at: F.struct(x["start"].alias("start"), x["end"].alias("end"), at.alias("at")))

        def stretch(part: Column) -> Column:
            begin = part[0]["at"]
            own = F.substring(text, begin + 1, F.element_at(part, -1)["end"] - begin)
            piece = lambda t, x: F.when((x["start"] > x["at"]) | (x["at"] == 0), F.concat(F.substring(t, x["at"] - begin + 1, x["start"] - x["at"]), F.lit(mark))).otherwise(F.lit(""))
            return F.element_at(F.transform(F.array(own), lambda t: F.array_join(F.transform(part, lambda x: piece(t, x)), "")), 1)

        def whole(p: Column) -> Column:
            parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / PART).cast("int")), lambda i: F.slice(p, i * PART + 1, F.lit(PART)))
            return F.concat(F.array_join(F.transform(parts, stretch), ""), F.substring(text, F.element_at(p, -1)["end"] + 1, F.length(text)))

        return F.when(F.size(r) == 0, text).otherwise(F.element_at(F.transform(F.array(pairs), whole), 1))

    return F.element_at(F.transform(F.array(order), lambda o: F.element_at(F.transform(F.array(runs(o)), cut), 1)), 1)
