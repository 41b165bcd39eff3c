"""Problem 10: texts cut off by a field limit or on their way.

Two kinds of evidence. *Length spikes*: per source, the lengths of the texts that do not
end with terminal punctuation are counted, in characters and in bytes, without a cut
mark and once for each different text; a length at which far more of them pile up than
around it, ending in many different words, is a field limit, and what ends there
without terminal punctuation was cut. A limit explains no text that was lost on its way,
at any length, so *tails* are tested too: a broken last character, an open code block,
bracket or code span, and last words that the whole corpus never ends with: word
fragments (unknown words that begin a common one), and words or pairs of words that are
common but close next to no sentence or line. Both counts are over all documents, each
different text once; every row is judged. Copies excuse nothing but a line of up to three
words that is said again and again ("ok"), and only that line itself.

A complete heading, list entry, code block, log line, short line, link or signature is
closed by words that do end lines elsewhere, so it is no case. Odd input: null, empty and
blank texts are no cases but count as texts; a null source is a source of its own;
repeated rows give one row each; texts are read whole; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.plans.session import cut_lineage

MIN_SPIKE = 3  # different texts at a limit, at least
PROMINENCE = 5.0  # times the mean count of the lengths around it, at least, ...
SIGMAS = 10.0  # ... and above it by so many of its square roots
AROUND = 20  # lengths on either side that a spike is held against
DIVERSITY = 0.5  # different last words in a spike, at least, as a share of its texts, ...
ENOUGH = 12  # ... or this many
SEEN = 100  # occurrences from which on a word's or pair's shares are believed
COMMON = 32  # occurrences from which on a word may have fragments
RARE = 0.05  # share of the occurrences of the word it begins, up to which a word inside texts may be a fragment
ENDS = 0.01  # share of occurrences that end a line or sentence, up to which a word goes on
PAIRS_HELD = 300_000  # different pairs of words that a task counts before it gives them away
SHORT = 3  # words of the longest line that copies of itself make a whole one
LAST = 0.01  # the same for occurrences that end a text openly, where cut texts count too

_STATED = re.compile(r"[\[(<]\s*(?:\.\.\.|…|more|read more|truncated|cut|cut off|snip|snipped|clipped|continued|message (?:clipped|truncated))[^\])>\n]{0,20}[\])>]", re.I)
_CLOSED = re.compile(r"[.!?。！？](?:[\"'`)\]}»”’*_]|\s)*$")
_OPEN_END = re.compile(r"[,;(\[{/&+=<“«„-]\s*$")
_UNIT = re.compile(r"[A-ZÀ-ÖØ-Þ]?[a-zß-öø-ÿ]++|[A-ZÀ-ÖØ-Þ]+(?![a-zß-öø-ÿ])|\d++|[^\W\d_a-zA-Zß-öø-ÿÀ-ÖØ-Þ]++")
_ENDS_HERE = r"[\"'`)\]}»”’*_]*+(?:[.!?:](?=[\"'`)\]}»”’*_]*+(?:\s|$))|[ \t\r]*+(?:\n|$))"
_UNITS = re.compile(f"({_UNIT.pattern})(?={_ENDS_HERE})|({_UNIT.pattern})")  # a unit that closes a line or sentence, or one that does not
_SENTENCE = re.compile(r"[.!?][\"'`)\]»”’]*\s+|\n")


def _units(text: str) -> list[str]:
    return ["#" if u[0].isdigit() else u.lower() for u in _UNIT.findall(text)]


def _last_units(line: str) -> list[str]:
    """The last units of a line, at least one more than a short line may have, if it has them: units hold no space."""
    k = 8
    while True:
        parts = line.rsplit(None, k)
        units = _units(" ".join(parts[1:] if len(parts) > k else parts))
        if len(units) > SHORT or len(parts) <= k:
            return units
        k *= 4


def _mark_at(text: str) -> int:
    """Where a cut mark that ends the text begins, with the space before it; the length of a text without one."""
    shown = text.rstrip()
    at = len(text)
    if shown.endswith("..."):
        at = len(shown) - 3
    elif shown.endswith("…"):
        at = len(shown) - 1
    elif shown.endswith(("]", ")", ">")):
        opens = max(shown.rfind(c) for c in "[(<")
        if opens >= 0 and _STATED.fullmatch(shown, opens):
            at = opens
    return len(text[:at].rstrip()) if at < len(text) else at


def tail(text: str) -> dict:
    """What the end of a text shows by itself."""
    body = text[: _mark_at(text)]
    mark = text[len(body) :]
    shown = body.rstrip()
    last = shown[shown.rfind("\n") + 1 :]
    fences = len(re.findall(r"(?m)^[ \t]*(?:```|~~~)", body)) if "```" in body or "~~~" in body else 0
    state = "plain"
    if not shown:
        state = "closed"
    elif fences % 2:
        state = "cut"
    elif re.search(r"(?m)^[ \t]*(?:```|~~~)[ \t]*$", last):
        state = "closed"
    elif shown.endswith("�"):
        state = "cut"
    elif re.match(r"\s*--\s*\S", last) and len(last) < 60:
        state = "closed"
    else:
        span = _SENTENCE.split(last)[-1]
        if _OPEN_END.search(shown) or last.count("`") % 2 or span.count("(") > span.count(")") or span.count("[") > span.count("]"):
            state = "cut"
        elif _CLOSED.search(shown):
            state = "closed"
    units = _last_units(last)
    size = len(body.encode("utf-8", "surrogatepass"))
    w1, w2 = (["", "", *units])[-2:]
    # an ellipsis after a capitalised phrase of up to three words is a manner of speaking
    spoken = "…" in mark[:4] and not mark.strip().endswith(("]", ")", ">")) or mark.strip() == "..."
    spoken = spoken and re.search(r"(?:^|\s)[A-ZÀ-ÖØ-Þ][\w'’]*(?:\s[\w'’]+){0,2}$", shown) is not None
    return {"mark": mark, "chars": len(body), "bytes": size, "raw_chars": len(text), "raw_bytes": size + len(mark.encode("utf-8", "surrogatepass")), "state": state, "w1": w1, "w2": w2, "spoken": spoken, "stated": mark.strip()[-1:] in ("]", ")", ">") and bool(mark), "word": re.search(r"[^\W_]\Z", shown) is not None, "short": "\n" not in shown and len(units) <= SHORT}


_TAIL = ("state", "stated", "chars", "bytes", "raw_chars", "raw_bytes", "w1", "w2", "spoken", "word", "short")
_TAIL_TYPES = "state string, stated boolean, chars int, bytes int, raw_chars int, raw_bytes int, w1 string, w2 string, spoken boolean, word boolean, short boolean"
_READ = f"print string, {_TAIL_TYPES}, n long, ends long, last long"


class _Words(dict):
    """Units as they are counted: in lower case, numbers all alike."""

    def __missing__(self, unit: str) -> str:
        self[unit] = w = "#" if unit[0].isdigit() else unit.lower()
        return w


def _pairs(text: str, words: _Words, n: Counter, ends: Counter, last: Counter) -> None:
    """Adds a text's pairs of neighbouring words, the first of a line or sentence after a line break, to the counts."""
    text = text[: _mark_at(text)]
    found = _UNITS.findall(text)
    if not found:
        return
    said = [words[a or b] for a, b in found]
    pairs = list(zip(["\n", *("\n" if a else w for (a, _), w in zip(found, said))], said))
    n.update(pairs)
    closing = [p for p, (a, _) in zip(pairs, found) if a]
    if found[-1][0] and text.endswith(found[-1][0]):
        last[closing.pop()] += 1
    ends.update(closing)


def _read(batches):
    """One pass over texts (print, text): what each one's end shows, and the counts of pairs of words of them all, added up over batches while they are few."""
    kinds = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in _READ.split(", "))])
    n: Counter = Counter()
    ends: Counter = Counter()
    last: Counter = Counter()
    words = _Words()

    def rows(size: int, cols: dict[str, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(cols[k], f.type) if k in cols else pa.nulls(size, f.type) for k, f in zip(schema.names, schema)], schema=schema)

    def counts() -> pa.RecordBatch:
        keys = list(n)
        return rows(len(keys), {"w1": [a for a, _ in keys], "w2": [b for _, b in keys], "n": list(n.values()), "ends": [ends[k] for k in keys], "last": [last[k] for k in keys]})

    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("print", *_TAIL)}
        for print_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            t = tail(text)
            out["print"].append(print_)
            for k in _TAIL:
                out[k].append(t[k])
            _pairs(text, words, n, ends, last)
            if len(n) > PAIRS_HELD:
                yield counts()
                for c in (n, ends, last, words):
                    c.clear()
        yield rows(batch.num_rows, out)
    if n:
        yield counts()


def read_texts(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(print and tail of each different text; pairs). Copies are dropped where they lie before texts move, and each different text is read once."""
    once = documents.filter("text is not null").select("text").distinct().select(F.md5("text").alias("print"), "text")
    read = cut_lineage(once.mapInArrow(_read, _READ))
    return read.filter("print is not null").select("print", *_TAIL), word_pairs(read.filter("print is null"))


def word_pairs(counted: DataFrame) -> DataFrame:
    """How often each pair of words (w1, w2) occurs and how often its second closes a line or sentence (ends) or, openly, a text (last), once for each different text of all documents: copies of a cut text are no proof that its last words close texts, and copies of a whole one none that its words go on. Counts of batches are added up."""
    return counted.groupBy("w1", "w2").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"), F.sum("last").alias("last"))


def length_spikes(tails: DataFrame, min_count: int = MIN_SPIKE, prominence: float = PROMINENCE) -> DataFrame:
    """source, unit (chars or bytes), length, texts: the field limits that the lengths of open-ended texts show."""
    long = tails.filter("state <> 'closed' and chars > 0").select("source", "print", "w2", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length")))).alias("x"))
    once = long.select("source", "print", "w2", "x.unit", "x.length").groupBy("source", "unit", "length", "print").agg(F.max("w2").alias("w2"))
    by = once.groupBy("source", "unit", "length", "w2").agg(F.count("*").alias("k")).groupBy("source", "unit", "length").agg(F.sum("k").alias("texts"), F.count("*").alias("words"))
    near = by.select("source", "unit", F.explode(F.sequence(F.col("length") - AROUND, F.col("length") + AROUND)).alias("at"), F.col("length").alias("other"), F.col("texts").alias("k"))
    mean = near.filter("at <> other").groupBy("source", "unit", F.col("at").alias("length")).agg((F.sum("k") / (2 * AROUND)).alias("mean"))
    same = [F.col("b.source").eqNullSafe(F.col("m.source")), F.col("b.unit") == F.col("m.unit"), F.col("b.length") == F.col("m.length")]
    joined = by.alias("b").join(mean.alias("m"), same, "left").select("b.*", F.coalesce("m.mean", F.lit(0.0)).alias("mean"))
    return joined.filter((F.col("texts") >= min_count) & (F.col("texts") >= prominence * F.col("mean")) & (F.col("texts") >= F.col("mean") + SIGMAS * F.sqrt("mean")) & (F.col("words") >= F.least(F.lit(ENOUGH), DIVERSITY * F.col("texts")))).select("source", "unit", "length", "texts")


def find_truncated(documents: DataFrame) -> DataFrame:
    """doc_id, source, cut, why (tail, limit, mark, word or null) of each document.

    Texts are judged once for each source and different text; the rows then take the
    judgement over, so that a text with many copies moves as prints only."""
    rows = documents.select("doc_id", "source", F.md5("text").alias("print"))
    ends, pairs = read_texts(documents)
    pairs = cut_lineage(pairs)
    held = rows.filter("print is not null").groupBy("source", "print").agg(F.count("*").alias("copies"))
    tails = cut_lineage(held.join(ends, "print"))
    limits = length_spikes(tails)
    open_ = tails.filter("state <> 'closed'")
    # with and without a cut mark, or with the space that went when the mark came, in either unit
    spaced = lambda c: F.when(F.col(f"raw_{c}") > F.col(c), F.col(c) + 1).otherwise(F.col(c))
    ways = F.array(*[F.struct(F.lit(u).alias("unit"), c.alias("length")) for u in ("chars", "bytes") for c in (F.col(u), F.col(f"raw_{u}"), spaced(u))])
    lengths = open_.select("print", F.explode(F.array_distinct(ways)).alias("x"), F.col("source").alias("s")).select("print", "s", "x.unit", "x.length")
    hit = lengths.join(limits, F.col("s").eqNullSafe(F.col("source")) & (lengths["unit"] == limits["unit"]) & (lengths["length"] == limits["length"]), "left_semi")
    hit = hit.select(F.col("s").alias("hit_source"), F.col("print").alias("hit_print"), F.lit(True).alias("at_limit")).distinct()
    at = open_.join(hit, F.col("source").eqNullSafe(F.col("hit_source")) & (F.col("print") == F.col("hit_print")), "left").drop("hit_source", "hit_print")
    asked = open_.filter("state = 'plain'").select("w1", "w2").distinct()
    # what closes other texts just as openly, again and again, is no accident
    goes_on = (F.col("n") >= SEEN) & (F.col("ends") <= ENDS * F.col("n")) & (F.col("last") <= LAST * F.col("n"))
    words = cut_lineage(pairs.groupBy("w2").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"), F.sum("last").alias("last")))
    single = words.join(asked.select("w2").distinct(), "w2", "left_semi").select("w2", goes_on.alias("on1"), F.col("n").alias("n1"), (F.col("n") - F.col("last")).alias("inside"))
    pair = pairs.join(asked, ["w1", "w2"], "left_semi").select("w1", "w2", "n", (F.col("n") - F.col("last")).alias("beside"), goes_on.alias("on2"))
    # a fragment begins a common word and, set against it, hardly stands inside texts: the beginnings of common words of those lengths that are asked for
    sizes = F.lit(sorted(r[0] for r in asked.select(F.length("w2").alias("k")).distinct().collect() if r[0])).cast("array<int>")
    begun = F.explode(F.transform(F.filter(sizes, lambda k: k < F.length("w2")), lambda k: F.substring("w2", F.lit(1), k)))
    starts = words.filter(f"n - last >= {COMMON}").select(begun.alias("w2"), (F.col("n") - F.col("last")).alias("begun")).groupBy("w2").agg(F.max("begun").alias("begun"))
    fragment = single.join(starts, "w2").filter(F.col("inside") <= RARE * F.col("begun")).select("w2", F.lit(True).alias("fragment"))
    # the same in company: a word that hardly follows the one before it, but begins one that often does
    pair_starts = pairs.filter(f"n - last >= {COMMON}").select("w1", begun.alias("w2"), (F.col("n") - F.col("last")).alias("begun")).groupBy("w1", "w2").agg(F.max("begun").alias("begun"))
    odd = pair.join(pair_starts, ["w1", "w2"]).filter(F.col("beside") <= RARE * F.col("begun")).select("w1", "w2", F.lit(True).alias("odd"))
    # a short line is whole where its copies alone close more than the share that cut texts may
    stock = open_.filter("short").groupBy("print").agg(F.sum("copies").alias("all_copies")).filter("all_copies > 1")
    seen = at.join(stock, "print", "left").join(single, "w2", "left").join(pair, ["w1", "w2"], "left").join(fragment, "w2", "left").join(odd, ["w1", "w2"], "left")
    on = F.when(F.col("n") >= SEEN, F.col("on2")).otherwise(F.coalesce("on1", F.lit(False)))
    letter = (F.length("w2") == 1) & F.col("w2").rlike(r"\p{L}") & ~F.col("w2").isin("a", "i", "y", "o", "e", "u", "à") & (F.coalesce("beside", F.lit(0)) <= RARE * F.col("n1"))
    whole = F.coalesce(F.col("all_copies") > LAST * F.col("n1"), F.lit(False))
    by_word = F.col("word") & ~F.col("spoken") & (F.col("fragment").isNotNull() | F.col("odd").isNotNull() | letter | (on & ~whole))
    why = F.when(F.col("state") == "cut", "tail").when(F.col("at_limit"), "limit").when(F.col("stated"), "mark").when(by_word, "word")
    judged = seen.select(F.col("source").alias("s"), F.col("print").alias("p"), why.alias("why"))
    return rows.join(judged, F.col("source").eqNullSafe(F.col("s")) & (F.col("print") == F.col("p")), "left").select("doc_id", "source", F.col("why").isNotNull().alias("cut"), "why")


def field_limits(rows: DataFrame, columns: list[str], source: str = "source") -> DataFrame:
    """column, source, unit, length, texts: the field limits that length spikes show in each of the text columns."""
    out = None
    for c in columns:
        texts = rows.select(F.col(source).alias("source"), F.col(c).alias("text"))
        ends, _ = read_texts(texts)
        found = length_spikes(texts.filter("text is not null").select("source", F.md5("text").alias("print")).distinct().join(ends, "print")).select(F.lit(c).alias("column"), "*")
        out = found if out is None else out.unionByName(found)
    return out
