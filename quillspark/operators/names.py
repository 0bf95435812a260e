"""Close names by keys that lose no pair, and misheard names of meetings found by what was written there."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import display as D
from quillspark.functions import text as X
from quillspark.operators.extract import ngrams
from quillspark.session import Kept

#: So many of the most frequent bigrams and letters have a place in the order of keys; others count as rarer than all of them.
RANKED = 4_096
#: A word has at most about so many keys for each length of its partner.
COMBINATIONS = 64
#: A task hands on its keys about so many at a time.
KEY_ROWS = 8_192
EPS = 1e-9
# Results depend on these words and bounds. Procedure, honorifics and the calendar make no name by themselves.
COMMON_WORDS = """
the a an and or of to in on for with by at from as we i he she they it this that
board council commission city district school schools meeting minutes agenda
motion second seconded carried approved approve ayes nays yeas present absent
mr mrs ms mx dr member members chair chairman chairwoman mayor alderman alderwoman
commissioner president vice resolution ordinance bill item items public hearing
monday tuesday wednesday thursday friday saturday sunday
january february march april may june july august september october november december
""".split()
# A name of several words is sure from HIGH, for review from FLOOR; a single word is for review from SINGLE; a rival within NEAR leaves none sure.
HIGH, FLOOR, SINGLE, NEAR = 0.92, 0.80, 0.88, 0.05
# Letters of the shortest name that is corrected to.
LEAST = 5


def jaro_winkler(a: str, b: str, boost: float = 0.1) -> float:
    """Jaro-Winkler similarity of two strings."""
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, hits = [False] * len(b), []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if not used[j] and b[j] == c), None)
        if j is not None:
            used[j] = True
            hits.append(c)
    if not hits:
        return 0.0
    other = [c for c, u in zip(b, used, strict=True) if u]
    swaps = sum(x != y for x, y in zip(hits, other, strict=True)) / 2
    m = len(hits)
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + boost * prefix * (1 - jaro)


def common_letters(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of it at a time as the bits of one number."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for c in b:
        hit = row & at.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def _rarest(items: list[str], rank: dict[str, int]) -> list[str]:
    """The multiset as 'item#occurrence', what the vocabulary has least of first; the order is the same for every name."""
    seen: dict[str, int] = {}
    out = []
    for x in items:
        seen[x] = seen.get(x, 0) + 1
        out.append((-seen[x], rank.get(x, -1), x))
    return [f"{x}#{-k}" for k, _, x in sorted(out)]


def ratio_keys(x: str, floor: float, rank: dict[str, int]) -> list[str]:
    """Bigrams one of which x shares with every y for which 2 * lcs / (a + b) reaches the floor.

    Of the lcs + 2 letters that both have in common, ends included, at least 3 * lcs + 1 - a - b neighbours are neighbours in
    both: (1.5 * floor - 1) * (a + b) + 1 at the floor, which is one at least where the floor is 2/3 or more. So two names share
    one of the rarest bigrams that are left when all but one of those are taken away.
    """
    a = len(x)
    least = ceil(a * floor / (2 - floor) - EPS)
    need = max(1, ceil((1.5 * floor - 1) * (a + least) + 1 - EPS))
    padded = f"\x02{x}\x03"
    grams = _rarest([padded[i : i + 2] for i in range(a + 1)], rank)
    return ["r" + g for g in grams[: a + 2 - need]]


def word_keys(x: str, floor: float, rank: dict[str, int], others: list[int], first: bool) -> list[str]:
    """Keys one of which x shares with every word whose Jaro-Winkler similarity reaches the floor.

    Words that begin with the same three letters share these. Others begin with p = 0, 1 or 2 equal ones, so their Jaro similarity is
    at least (floor - p / 10) / (1 - p / 10), and that of words of a and b letters tells how many letters m they have in common. Sets of k of
    the rarest a - m + k letters, with p letters and both lengths, are the key. `others` are the lengths on the other side.
    """
    a, out = len(x), ["p" + x[:3]] if len(x) >= 3 else []
    rare = _rarest(list(x), rank)
    for b in others:
        for p in range(min(2, a, b) + 1):
            jaro = (floor - p / 10) / (1 - p / 10)
            m = max(1, ceil((3 * jaro - 1) * a * b / (a + b) - EPS))
            if m > min(a, b):
                continue
            k = next((k for k in (3, 2) if k <= m and comb(max(a, b) - m + k, k) <= COMBINATIONS), 1)
            sizes = f"{a},{b}" if first else f"{b},{a}"
            out += [f"j{p}{x[:p]}|{sizes}|{' '.join(c)}" for c in combinations(rare[: a - m + k], k)]
    return out


def _order(names: DataFrame) -> dict[str, int]:
    """The place of the most frequent bigrams and letters of the names, rare ones first: at most 2 * RANKED entries."""
    padded = F.concat(F.lit("\x02"), F.col("x"), F.lit("\x03"))
    grams = F.transform(F.sequence(F.lit(1), F.length("x") + 1), lambda i: F.substring(padded, i, F.lit(2)))
    out = {}
    for items in (grams, F.split("x", "")):
        top = names.select(F.explode(items).alias("g")).groupBy("g").count().orderBy(F.desc("count"), "g").limit(RANKED).collect()
        out |= {r["g"]: -k for k, r in enumerate(top)}
    low = min(out.values(), default=0)
    return {g: v - low for g, v in out.items()}


def close_pairs(phrases: DataFrame, names: DataFrame, phrase: str, name: str, floor: float = 0.8, within: str | None = None) -> DataFrame:
    """(p, v, score): all pairs of a phrase and another name, of a token count that differs by one at most, whose score reaches the floor.

    With `within`, a column of both sides that comes first in the result, pairs are those of equal values of it.

    Names of several words compare by the edit ratio 2 * lcs / (a + b); single words by the higher of that and Jaro-Winkler. Pairs
    meet by an equal join on keys (ratio_keys, word_keys) that lose none of them; what meets is scored exactly. Null and empty names
    meet nothing; repeated ones count once. Raises ValueError for a floor below 2/3, where the keys would lose pairs.
    """
    if floor < 2 / 3:
        raise ValueError("the floor of close_pairs is at least 2/3")
    g = F.col(within) if within else F.lit(0)
    each = [df.select(F.col(c).alias("x"), g.alias("g")).where((F.length("x") > 0) & F.col("g").isNotNull()).distinct() for df, c in ((phrases, phrase), (names, name))]
    of_group = f"g {each[0].schema['g'].dataType.simpleString()}"
    rank = _order(each[1])
    single = ~F.contains(F.col("x"), F.lit(" "))
    if within:  # a name has keys for the lengths of single words that its own group has on the other side, and none where that side is empty
        sizes = [df.groupBy("g").agg(F.array_sort(F.collect_set(F.when(single, F.length("x")))).alias("others")) for df in each]
        each = [df.join(n.hint("merge"), "g") for df, n in zip(each, sizes[::-1], strict=True)]
    else:
        sizes = [sorted(r["n"] for r in df.where(single).select(F.length("x").alias("n")).distinct().collect()) for df in each]  # a number for each length
        each = [df.withColumn("others", F.lit(n).cast("array<int>")) for df, n in zip(each, sizes[::-1], strict=True)]

    def keyed(df: DataFrame, first: bool, alias: str) -> DataFrame:
        def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = []
                for x, g, others in zip(pdf["x"], pdf["g"], pdf["others"], strict=True):
                    rows += [(k, x, g) for k in dict.fromkeys(ratio_keys(x, floor, rank) + ([] if " " in x else word_keys(x, floor, rank, others.tolist(), first)))]
                    if len(rows) >= KEY_ROWS:
                        yield pd.DataFrame(rows, columns=["key", "x", "g"])
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["key", "x", "g"])

        words = F.size(F.split("x", " "))
        return df.mapInPandas(keys, f"key string, x string, {of_group}").select(F.xxhash64("key").alias("k"), "g", F.substring("key", 1, 1).alias(f"{alias}k"), F.col("x").alias(alias), words.alias(f"{alias}w"), F.length("x").alias(f"{alias}n"))

    def similar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            scores = [max(2 * common_letters(a, b) / (len(a) + len(b)), jaro_winkler(a, b) if " " not in a + b else 0.0) for a, b in zip(pdf["p"], pdf["v"], strict=True)]
            yield pdf.assign(score=pd.Series(scores, dtype="float64", index=pdf.index))

    a, b = keyed(each[0], True, "p"), keyed(each[1], False, "v")
    long_enough = (F.col("pk") != "r") | (2 * F.least("pn", "vn") >= floor * (F.col("pn") + F.col("vn")) - EPS)
    met = a.join(b.hint("merge"), ["k", "g"]).where((F.col("p") != F.col("v")) & (F.abs(F.col("pw") - F.col("vw")) <= 1) & long_enough)
    out = met.select("g", "p", "v").distinct().mapInPandas(similar, f"{of_group}, p string, v string, score double").where(F.col("score") >= floor)
    return out.withColumnRenamed("g", within) if within else out.drop("g")


def norm(x: Column) -> Column:
    """The form that names are compared in: apostrophes dropped, then the key of a person's name."""
    return X.name_key(F.regexp_replace(x, "['’]", ""))


def common(x: Column, words: list[str]) -> Column:
    """Whether a phrase has common words alone."""
    return F.forall(F.split(x, " "), lambda w: w.isin(words))


def surfaces(docs: DataFrame, meeting: str, text: str, longest: int = 4) -> DataFrame:
    """(meeting, norm, surface, n): runs of capitalised words on a line, all their n-grams, counted by meeting and normal form.

    A mark that ends a clause ends a run. The surface is the most frequent one, of equal ones the smallest.
    """
    word = r"\p{Lu}[^\s.,;:!?()\[\]{}\"“”]*"
    found = F.regexp_extract_all(F.col(text), F.lit(rf"((?<![^\s(\[\"“]){word}(?:[ \t]+{word})*)"), F.lit(1))
    grams = docs.select(F.col(meeting).alias("meeting"), F.explode(found).alias("run")).select("meeting", F.explode(ngrams(F.split("run", r"[ \t]+"), longest)).alias("surface"))
    counts = grams.groupBy("meeting", norm(F.col("surface")).alias("norm"), "surface").agg(F.count("*").alias("n")).where("norm <> ''")
    best = F.min_by("surface", F.struct((-F.col("n")).alias("a"), F.col("surface").alias("b")))
    return counts.groupBy("meeting", "norm").agg(best.alias("surface"), F.sum("n").alias("n"))


def vocabulary(lexicon: DataFrame, written: DataFrame, name: str, meeting: str, text: str, least: int = LEAST, words: list[str] = COMMON_WORDS) -> DataFrame:
    """(meeting, norm, canonical, source, target): the names that are right, of the lexicon (in all meetings: meeting is null) and of what was written of each.

    All are known to be right; target tells those that a misheard name may be corrected to: of `least` letters or more, not of
    common words alone, and of a meeting's own names those that the lexicon lacks.
    """
    fit = lambda: (F.length("norm") >= least) & ~common(F.col("norm"), words)
    people = lexicon.select(norm(F.col(name)).alias("norm"), F.col(name).alias("c")).where("norm <> ''").groupBy("norm").agg(F.min("c").alias("canonical"))
    own = surfaces(written, meeting, text)
    out = own.join(people.select("norm", F.lit(True).alias("lex")), "norm", "left").select("meeting", "norm", F.col("surface").alias("canonical"), F.lit("written").alias("source"), (F.col("lex").isNull() & fit()).alias("target"))
    return people.select(F.lit(None).cast(own.schema["meeting"].dataType).alias("meeting"), "norm", "canonical", F.lit("lexicon").alias("source"), fit().alias("target")).unionByName(out)


def misheard(spoken: DataFrame, names: DataFrame, meeting: str, text: str, corrected: DataFrame | None = None, high: float = HIGH, floor: float = FLOOR, single: float = SINGLE, near: float = NEAR, words: list[str] = COMMON_WORDS, kept: Kept | None = None) -> DataFrame:
    """(meeting, mangled, surface, canonical, source, score, n, confidence): phrases of a meeting's transcript that are close to a name of it and right nowhere in it.

    names comes from `vocabulary`, corrected holds the forms that have a correction already (column mangled). No spelling is
    made up: both sides stand in the record. Phrases of common words, single words that are a part of a right name, and variants
    in spacing or a plural s are left out. Of several names the closest wins, ties by name; where another is within `near`, the
A phrase that is a run of words of a longer one of the meeting is left out.
    Names, phrases and hits are written once each; kept belongs to the caller. What grows with the corpus is merged, never broadcast:
    the written files are small beside the rows they hold.
    """
    kept = kept or Kept(spoken.sparkSession, "misheard")
    names, said = kept.keep(names, "names"), surfaces(spoken, meeting, text)
    everywhere, own = names.where("meeting IS NULL"), names.where("meeting IS NOT NULL")
    said = said.where(~common(F.col("norm"), words)).join(everywhere.select("norm"), "norm", "left_anti").join(own.select("meeting", "norm").distinct().hint("merge"), ["meeting", "norm"], "left_anti")
    if corrected is not None:
        said = said.join(corrected.select(norm(F.col("mangled")).alias("norm")), "norm", "left_anti")
    part = F.explode(F.split("norm", " ")).alias("norm")  # single words alone can meet these
    said = said.join(everywhere.select(part).distinct(), "norm", "left_anti").join(own.select("meeting", part).distinct().hint("merge"), ["meeting", "norm"], "left_anti")
    said, targets = kept.keep(said, "said"), names.where("target")
    t = targets.withColumnRenamed("norm", "v")
    lexicon, written = t.where("meeting IS NULL").drop("meeting"), t.where("meeting IS NOT NULL")
    spoken_of = said.withColumnRenamed("norm", "p")
    columns = ["meeting", "p", "v", "surface", "canonical", "source", "score", "n"]
    hits = close_pairs(said, lexicon, "norm", "v", floor).join(lexicon, "v").join(spoken_of.hint("merge"), "p").select(columns)
    hits = hits.unionByName(close_pairs(said, written.withColumnRenamed("v", "norm"), "norm", "norm", floor, "meeting").join(written.hint("merge"), ["meeting", "v"]).join(spoken_of.hint("merge"), ["meeting", "p"]).select(columns))
    hits = hits.where(~D.trivial_variant(F.col("p"), F.col("v"))).withColumn("confidence", D.confidence(F.col("p"), F.col("v"), F.col("score"), high, floor, single)).where("confidence IS NOT NULL")
    w = Window.partitionBy("meeting", "p").orderBy(F.desc("score"), "canonical")  # the names close to one phrase
    best = hits.withColumn("k", F.row_number().over(w)).withColumn("rival", F.lead("score").over(w)).where("k = 1")
    sure = F.when((F.col("confidence") == "high") & (F.coalesce(F.col("rival"), F.lit(0.0)) < F.col("score") - near), "high").otherwise("review")
    out = best.select("meeting", F.col("p").alias("mangled"), "surface", "canonical", "source", F.round("score", 6).alias("score"), "n", sure.alias("confidence"))
    out = kept.keep(out, "hits")
    shorter = out.select("meeting", F.col("mangled").alias("whole"), F.explode(ngrams(F.split("mangled", " "))).alias("mangled")).where("mangled <> whole").select("meeting", "mangled").distinct()
    return out.join(shorter.hint("merge"), ["meeting", "mangled"], "left_anti")


def proposals(found: DataFrame, shown: int = 3) -> DataFrame:
    """One row for each misheard form over all meetings: the best name, meetings, occurrences, rivals, and the `shown` best meetings.

    High where one meeting is sure and all agree on the name; forms with several names are for review.
    """
    rows = found.groupBy("mangled", "canonical").agg(
        F.max("score").alias("score"), F.max((F.col("confidence") == "high").cast("int")).alias("sure"), F.count_distinct("meeting").alias("meetings"), F.sum("n").alias("n"), F.min("source").alias("source")
    )
    w = Window.partitionBy("mangled").orderBy(F.desc("score"), "canonical")  # the names of one form
    all_of = Window.partitionBy("mangled")
    names = rows.withColumn("k", F.row_number().over(w)).withColumn("sure", F.max("sure").over(all_of)).withColumn("rivals", F.count("*").over(all_of) - 1).withColumn("occurrences", F.sum("n").over(all_of)).where("k = 1")
    in_meetings = found.groupBy("mangled").agg(F.count_distinct("meeting").alias("meetings"))
    cut = Window.partitionBy("mangled").orderBy(F.desc("score"), "meeting")
    evidence = found.withColumn("e", F.row_number().over(cut)).where(F.col("e") <= shown).groupBy("mangled").agg(F.transform(F.array_sort(F.collect_list(F.struct("e", "meeting"))), lambda s: s["meeting"].cast("string")).alias("evidence"))
    confidence = F.when((F.col("sure") == 1) & (F.col("rivals") == 0), "high").otherwise("review")
    out = names.drop("meetings").join(in_meetings, "mangled").join(evidence, "mangled")
    return out.select("mangled", "canonical", "source", "score", confidence.alias("confidence"), "meetings", "occurrences", "rivals", F.array_join("evidence", ",").alias("evidence"))
