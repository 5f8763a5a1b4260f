"""Dictionary decomposition of compounds.

A word is cut into terms of a term base from left to right. Where nothing follows a term, one or two trailing
letters before a word boundary count as an ending, or a linking element as glue; both may belong to the term.

The term base may have any size: the substrings of the words are joined with it. What is found makes a graph for each
word, whose arcs lead from a place to the next; a fold from the end of the word says which arcs lead on to its end, and
where an ending or glue is left out for that. The best decomposition in one language is another fold; rankings walk the
graph, best first, and do no more than what they return asks for.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import recase
from lexmill.operators.lookup import lookup
from lexmill.shared import written

#: Linking elements between parts, in the order in which they are tried (fixed values, as a pattern).
LINKS = "^(s|e|en|er|n)"
#: One or two characters that end a word (fixed value, as a pattern).
ENDING = "(?U)^..?\\b"
#: Characters that are left out between parts (fixed values, as a pattern).
BLANKS = "^[ \\t\\n\\x0B\\f\\r]+"
#: The part that in German also counts as the end of the part before (fixed values; parts of one letter, which would too,
#: cannot occur).
PLURAL, PLURAL_LANGUAGE = "en", "de"
#: What a word's arcs are: from a place to a place, and the part between.
ARCS = "array<struct<at:int,to:int,part:string>>"

Arc = tuple[int, int, str]


# terms in words


def occurrences(words: DataFrame, terms: DataFrame, column: str) -> DataFrame:
    """(word, at, term, late): the terms inside each different word, of two characters or more, wherever they occur; ``late``
    if in its last two characters. An equality join on substrings, none longer than the longest term; frequent ones are
    dealt."""
    longest = terms.agg(F.max(F.length("term"))).first()[0] or 0  # one number
    low = F.lower(F.col(column))
    n = F.length(low)
    starts = F.when(n > 2, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    each = words.select(column).distinct().select(column, low.alias("_low"), F.explode(starts).alias("_i"))
    most = F.least(F.length("_low") - F.col("_i") + 1, F.lit(longest))
    sizes = F.when(most >= 2, F.sequence(F.lit(2), most)).otherwise(F.array().cast("array<int>"))
    each = each.select(column, "_low", "_i", F.explode(sizes).alias("_n"))
    subs = each.select(column, (F.col("_i") - 1).alias("at"), F.substr("_low", "_i", "_n").alias("term"))
    late = F.col("at") > F.length(F.lower(F.col(column))) - 3
    return lookup(subs, terms.select("term").distinct(), ["term"], [column, "at"], "left_semi").select(column, "at", "term", late.alias("late"))


def filter_terms(words: DataFrame, terms: DataFrame, column: str = "word") -> DataFrame:
    """(word, term): the terms inside each word that do not start in its last two characters."""
    return occurrences(words, terms, column).filter("not late").select(column, "term").distinct()


def arcs(words: DataFrame, terms: DataFrame, column: str = "word") -> DataFrame:
    """(word, arcs): for each different word with terms in it, the arcs that lead on to its end, the last places first.

    A part leads to the next place that is no blank. If no part leads on from there, it leads past an ending (one or two
    characters before a word boundary, then blanks) or past glue, and is prolonged by it if the word has that term too.
    Terms that only start in a word's last two characters count as none of its terms.
    """
    found = occurrences(words, terms, column).groupBy(column).agg(F.sort_array(F.collect_list(F.struct("at", "term", "late")), asc=False).alias("_all"))
    early = F.transform(F.filter("_all", lambda t: ~t["late"]), lambda t: t["term"])
    found = found.withColumn("_early", early).select(column, F.filter("_all", lambda t: F.array_contains("_early", t["term"])).alias("_terms"))
    low = F.lower(F.col(column))
    past = lambda at: at + F.length(F.regexp_extract(F.substr(low, at + 1), BLANKS, 0))
    second = lambda x: F.substr(x, F.lit(2), F.lit(1))

    def placed(x: Column) -> Column:
        one = past(x["at"] + F.length(x["term"]))
        return F.struct(x["at"].alias("at"), x["term"].alias("term"), one.alias("one"))

    def rest(x: Column) -> Column:
        return F.struct(*[x[c].alias(c) for c in ("at", "term", "one")], F.substr(low, x["one"] + 1).alias("rest"))

    def extra(x: Column) -> Column:
        ends = x["rest"].rlike(ENDING)
        letters = F.substr(x["rest"], F.lit(1), F.when(second(x["rest"]).rlike("\\p{L}"), 2).otherwise(1))
        return F.struct(*[x[c].alias(c) for c in ("at", "term", "one")], ends.alias("ends"), F.when(ends, letters).otherwise(F.regexp_extract(x["rest"], LINKS, 1)).alias("extra"))

    def ways(x: Column) -> Column:
        to, longer = x["one"] + F.length(x["extra"]), F.concat(x["term"], x["extra"])
        two = F.when(x["extra"] != "", F.when(x["ends"], past(to)).otherwise(to))
        known = F.exists("_terms", lambda t: t["term"] == longer)
        return F.struct(x["at"].alias("at"), x["one"].alias("one"), x["term"].alias("term"), two.alias("two"), F.when(known, longer).otherwise(x["term"]).alias("longer"))

    each = F.col("_terms")
    for step in (placed, rest, extra, ways):
        each = F.transform(each, step)
    ways_ = found.select(column, each.alias("_ways"))
    leads = lambda reached, to: F.coalesce(F.array_contains(reached, to), F.lit(False))
    # places from which the end is reached, the last first; later places are done before earlier ones
    grown = lambda acc, x: F.when((leads(acc, x["one"]) | leads(acc, x["two"])) & (F.element_at(acc, -1) != x["at"]), F.array_append(acc, x["at"])).otherwise(acc)
    reached = ways_.withColumn("_reached", F.aggregate("_ways", F.array(F.length(low)), grown))
    on = lambda x: leads(F.col("_reached"), x["one"])
    good = F.filter("_ways", lambda x: on(x) | leads(F.col("_reached"), x["two"]))
    kept = F.transform(good, lambda x: F.struct(x["at"].alias("at"), F.when(on(x), x["one"]).otherwise(x["two"]).alias("to"), F.when(on(x), x["term"]).otherwise(x["longer"]).alias("part")))
    return reached.select(column, kept.cast(ARCS).alias("arcs"))


# the best first


def recased(part: str, word: str) -> str:
    """A part in the case of its word: all upper, all lower, or its first letter raised; else as it is."""
    letters = [c for c in word if c.isalpha()]
    if word and all(unicodedata.category(c) == "Lu" for c in letters):
        return part.upper()
    if all(unicodedata.category(c) == "Ll" for c in letters):
        return part.lower()
    if letters and unicodedata.category(letters[0]) == "Lu":
        return next((part[:i] + c.upper() + part[i + 1 :] for i, c in enumerate(part) if c.isalpha()), part)
    return part


def joined(out: dict[int, list[tuple[int, str]]], end: int) -> dict[tuple, list[tuple[tuple, str]]]:
    """The graph of segmentations whose plural endings have joined the part before: (state, part) of each state.

    Endings join from left to right, an ending behind one that has just joined stays (``held``), and the last part joins
    in any case. States are places and what may come next: anything at the start, no ending after a part that none joined.
    """
    graph: dict[tuple, list[tuple[tuple, str]]] = {}
    todo = [(0, "start")]
    while todo:
        state = todo.pop()
        if state in graph or state[0] == end:
            continue
        at, kind = state
        arcs_: list[tuple[tuple, str]] = []
        for to, part in out.get(at, ()):
            if part == PLURAL and (kind == "free" or kind == "held" and to == end):
                continue
            arcs_.append(((to, "end" if to == end else "free"), part))
            for after, ending in out.get(to, ()):
                if ending == PLURAL:
                    arcs_.append(((after, "end" if after == end else "held"), part + PLURAL))
                    arcs_ += [((end, "end"), part + 2 * PLURAL) for last, x in out.get(after, ()) if x == PLURAL and last == end and after != end]
        graph[state] = arcs_
        todo += [s for s, _ in arcs_]
    return graph


def best_first(found: list[Arc], word: str, language: str) -> Iterator[tuple[str, ...]]:
    """The different segmentations of a word, in its case: those of fewer parts first, then by their parts.

    The graph is walked with sets of states, so that each segmentation comes once whatever ways lead to it; each state
    knows, as bits of a number, in how many parts it can reach the end, so that no step is in vain.
    """
    end, out = len(word.lower()), defaultdict(list)
    for at, to, part in found:
        out[at].append((to, part))
    graph = {(at, "plain"): [((to, "end" if to == end else "plain"), part) for to, part in ways] for at, ways in out.items()}
    starts = {(0, "plain" if end else "end")}
    if language == PLURAL_LANGUAGE and any(part == PLURAL for _, _, part in found):
        graph |= joined(out, end)
        starts.add((0, "start"))
    labels: dict[tuple, dict[str, set[tuple]]] = defaultdict(lambda: defaultdict(set))
    counts = defaultdict(int, {(end, "end"): 1})
    for state in sorted(graph, reverse=True):  # arcs lead to later places
        for to, part in graph[state]:
            labels[state][recased(part, word)].add(to)
            counts[state] |= counts[to] << 1
    lengths = 0
    for state in starts:
        lengths |= counts[state]

    def choices(states: set[tuple], left: int) -> Iterator[tuple[str, set[tuple]]]:
        following = defaultdict(set)
        for state in states:
            for part, to in labels[state].items():
                following[part] |= {s for s in to if counts[s] >> (left - 1) & 1}
        return iter(sorted((part, to) for part, to in following.items() if to))

    for length in (n for n in range(lengths.bit_length()) if lengths >> n & 1):
        if not length:
            yield ()
            continue
        parts: list[str] = []
        stack = [choices(starts, length)]
        while stack:
            step = next(stack[-1], None)
            if step is None:
                stack.pop()
                if parts:
                    parts.pop()
            elif len(parts) + 1 == length:
                yield (*parts, step[0])
            else:
                parts.append(step[0])
                stack.append(choices(step[1], length - len(parts)))


def decompose_ranked(words: DataFrame, terms: DataFrame, column: str = "word", language: str = "en", most: int | None = None) -> DataFrame:
    """(word, rank, score, parts): the decompositions of each different word, best first, ``most`` of them at most.

    The score is one over the number of parts; an empty word has one decomposition, of no parts. Null words have none.
    All decompositions of a word may be very many; they are made one after another and sent on in parts.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [column, "rank", "score", "parts"]
        for batch in batches:
            rows: list[tuple] = []
            for word, found in zip(batch[column], batch["arcs"], strict=True):
                ways = best_first([(x["at"], x["to"], x["part"]) for x in found] if found is not None else [], word, language)
                for k, parts in enumerate(islice(ways, most)):
                    rows.append((word, k + 1, 1 / len(parts) if parts else float("inf"), list(parts)))
                    if len(rows) >= 10_000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
            yield pd.DataFrame(rows, columns=names)

    empty = words.select(column).filter(F.col(column) == "").distinct().select(column, F.array().cast(ARCS).alias("arcs"))
    return arcs(words, terms, column).union(empty).mapInPandas(run, f"{column} string, rank int, score double, parts array<string>")


def best_parts(found: DataFrame, column: str) -> DataFrame:
    """(word, parts) of the best decomposition: from the end, each place keeps the fewest parts, and of these the first."""
    low = F.lower(F.col(column))
    entry = "struct<at:int,n:int,parts:array<string>>"
    start = F.array(F.struct(F.length(low).alias("at"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("parts"))).cast(f"array<{entry}>")

    def grown(acc: Column, x: Column) -> Column:
        tail = F.get(F.filter(acc, lambda y: y["at"] == x["to"]), F.lit(0))
        mine = F.struct(x["at"].alias("at"), (tail["n"] + 1).alias("n"), F.concat(F.array(x["part"]), tail["parts"]).alias("parts")).cast(entry)
        last = F.element_at(acc, -1)
        return F.when(last["at"] == x["at"], F.array_append(F.slice(acc, 1, F.size(acc) - 1), F.least(last, mine))).otherwise(F.array_append(acc, mine)).cast(f"array<{entry}>")

    cased = F.transform("arcs", lambda x: F.struct(x["at"].alias("at"), x["to"].alias("to"), recase(x["part"], F.col(column)).alias("part")))
    done = F.element_at(F.aggregate(cased, start, grown), -1)
    return found.select(column, F.when(done["at"] == 0, done["parts"]).otherwise(F.array().cast("array<string>")).alias("parts"))


def decompose_best(words: DataFrame, terms: DataFrame, column: str = "word", language: str = "en") -> DataFrame:
    """``words`` with ``parts``, the best decomposition: empty if there is none, null for null words."""
    if language == PLURAL_LANGUAGE:
        best = decompose_ranked(words, terms, column, language, 1).select(column, F.col("parts").alias("_parts"))
    else:
        best = best_parts(arcs(words, terms, column), column).withColumnRenamed("parts", "_parts")
    none = F.when(F.col(column).isNotNull(), F.array().cast("array<string>"))
    return lookup(words, best, [column], [c for c in words.columns if c != column] or [column]).withColumn("parts", F.coalesce("_parts", none)).drop("_parts")


def decompose_lines(lines: DataFrame, terms: DataFrame, column: str = "value", language: str = "en") -> DataFrame:
    """``lines`` with each word that has several parts replaced by them, joined by blanks.

    Each different word is decomposed once; only those of several parts go back to their lines, frequent ones dealt.
    """
    rows = written(lines.withColumn("_line", F.monotonically_increasing_id()), "lines")
    words = rows.select("_line", F.posexplode(F.split(column, " ")).alias("_pos", "word"))
    best = decompose_best(words.select("word").distinct(), terms, "word", language).filter(F.size("parts") > 1)
    changed = lookup(words, written(best.select("word", F.array_join("parts", " ").alias("_to")), "decomposed"), ["word"], ["_line", "_pos"], "inner")
    by_line = changed.groupBy("_line").agg(F.map_from_entries(F.collect_list(F.struct("_pos", "_to"))).alias("_new"))
    each = F.transform(F.split(column, " "), lambda w, i: F.coalesce(F.try_element_at("_new", i), w))
    return rows.join(by_line, "_line", "left").withColumn(column, F.when(F.col("_new").isNull(), F.col(column)).otherwise(F.array_join(each, " "))).drop("_line", "_new")
