"""Template residue, filler text, error pages and script notices in mails.

1. Each mail is read once: subject and own message, decoded, cut into units
   (sentences of its paragraphs) in which slots, void values and variable parts
   are masked. Each unit carries how much the mail has to say besides.
2. Message templates are mined from the distinct units with a prefix tree of
   fixed depth: number of words, then the first words and the places of masked
   parts, then the telling words. Within a leaf a unit joins the template it
   shares enough positions with, and positions that differ become wildcards,
   which a telling word never is. Units lie in ``SALTS`` parts, whatever their
   number, and the templates of the parts are mined again together.
3. Each template is classified once: its exemplar is put to a grammar of
   concepts (a thing and its failure, scripts and their state, a text and its
   absence), and its mails give evidence: a template that mostly stands amid
   what people have to say is speech, however it reads; one that stands in
   place of a message is residue. A void value counts where other mails show a
   slot in its place. Verdicts go to all units of a template and from them to
   the mails; a mail that says more besides an error page or a notice than
   ``AMID`` sentences cites it.
4. Slots left open inside otherwise ordinary sentences are told by their syntax
   alone, template by template.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm import concepts, mime
from quillstream.llm.concepts import BLANK, CUT, NUMBER, SLOT, VOID
from quillstream.session import cut, lookup_join, shipped, stored

#: Words of a unit that choose its leaf, after their number.
DEPTH = 2
#: Share of equal positions from which a unit joins a template.
SIMILAR = 0.6
#: Parts of each leaf that are mined apart before their templates are mined together.
SALTS = 64
#: Sentences in other paragraphs from which a mail is taken to say something itself.
AMID = 2
#: Share of a template's mails that have nothing else to say, from which an error or a notice is no speech.
ALONE = 0.5
#: Words that a unit may have, and letters that a word may have; longer sentences and words are cut into several,
#: each of which begins in the middle of the one before, so that what is no longer than half of one lies whole in one.
UNIT_WORDS, WORD_LETTERS = 60, 400

WILD = "<*>"
_ANSWER = re.compile(r"^(?:\s*(?:re|aw|fwd?|wg|tr|rv|res|enc|sv)\s*:)+\s*", re.I)
_ENDS = re.compile(r"(?<=[.!?。।！？])[\"')\]*]*\s+|(?<=[。！？])")
_RULE = re.compile(r"\s*(?:[*_=~-]{3,}|-- ?)\s*$")
_CLOSED = re.compile(r"[.!?。।！？…][\"'”»)\]*\s]*$")


def subject_unit(subject: str) -> str:
    """The subject without marks of answers, as a unit."""
    return concepts.masked(_ANSWER.sub("", subject))


def paragraphs(lines: list[str]) -> Iterator[tuple[str, bool]]:
    """Each paragraph, and whether it stands above its part's signature or first rule.

    Empty lines, rules and marks of signatures end a paragraph. What stands
    below a signature's mark is read like the rest, but isn't what the mail has
    to say: there stand names and disclaimers.
    """
    paragraph: list[str] = []
    above = True
    for line in [*lines, ""]:
        rule = line == mime.NEXT_PART or bool(_RULE.match(line))
        if line.strip() and not rule:
            paragraph.append(line.strip())
            continue
        if paragraph:
            yield " ".join(paragraph), above
            paragraph = []
        if rule:
            above = line == mime.NEXT_PART


def _cut_up(paragraph: str) -> list[str]:
    out = []
    for s in _ENDS.split(paragraph):
        words = s.split()
        if len(words) > UNIT_WORDS or len(s) > WORD_LETTERS and max(map(len, words), default=0) > WORD_LETTERS:
            out += _windows(s)
        elif words:
            out.append(" ".join(words))
    return out


def sentences(lines: list[str]) -> list[str]:
    """The sentences of all paragraphs."""
    return [s for p, _ in paragraphs(lines) for s in _cut_up(p)]


def _windows(sentence: str) -> list[str]:
    """The units of a long sentence, overlapping by half; slots and void values are masked before it is cut."""
    whole = concepts.opened(sentence).split()
    words = [w[k : k + WORD_LETTERS] for w in whole for k in range(0, len(w), WORD_LETTERS)]
    starts = range(0, max(len(words) - UNIT_WORDS // 2, 1), UNIT_WORDS // 2)
    out = [" ".join([CUT] * (k > 0) + words[k : k + UNIT_WORDS] + [CUT] * (k + UNIT_WORDS < len(words))) for k in starts]
    # and what lies over the cuts within a word
    return out + [f"{CUT} {w[k : k + WORD_LETTERS]} {CUT}" for w in whole for k in range(WORD_LETTERS // 2, len(w) - WORD_LETTERS // 2, WORD_LETTERS)]


def says_something(sentence: str) -> bool:
    """A whole sentence: closed by a mark, and of five words or, in scripts without spaces, sixteen letters."""
    if not _CLOSED.search(sentence):
        return False
    return len(sentence.split()) >= 5 or len(sentence) >= 16 and max(map(len, sentence.split())) >= 16 and ord(sentence[0]) > 0x2FF


def mail_units(text: str | None) -> list[tuple[str, int, int, int]]:
    """Of a mail in order: unit, paragraph (0 is the subject), sentences said in that paragraph, sentences said in all."""
    subject, lines = mime.read(text)
    rows: list[tuple[str, int, int]] = [(u, 0, 0)] if (u := subject_unit(subject)) else []
    total = 0
    for n, (p, above) in enumerate(paragraphs(lines), 1):
        parts = _cut_up(p)
        said = sum(map(says_something, parts)) if above else 0
        total += said
        rows += [(u, n, said) for u in map(concepts.masked, parts) if u]
    return [(*r, total) for r in rows]


def unit_rows(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, mail (a hash of the text), unit, para, said and total: a row for each unit of each mail in order; none for null and empty texts."""
    shipped(documents.sparkSession)
    picked = documents.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("mail"), F.col(text).cast("string").alias("text"))
    row = pa.struct([("unit", pa.string()), ("para", pa.int32()), ("said", pa.int32()), ("total", pa.int32())])
    schema = picked.drop("text").selectExpr("*", "cast(null as array<struct<unit: string, para: int, said: int, total: int>>) as units").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = [mail_units(value.as_py()) for value in batch.column(2)]
            rows = [r for units in flat for r in units]
            ends = [0]
            for units in flat:
                ends.append(ends[-1] + len(units))
            columns = [pa.array([r[k] for r in rows], row.field(k).type) for k in range(4)]
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(row)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), listed], names=["doc_id", "mail", "units"])

    return picked.mapInArrow(run, schema).select("doc_id", "mail", F.inline("units"))


# ------------------------------------------------------------------- mining


def _leaf(words):
    """The leaf of a unit: its number of words, the first ones, and where its masked parts stand."""
    variable = lambda w: F.when(w.rlike("[0-9<]"), F.lit(WILD)).otherwise(w)
    special = F.filter(F.transform(words, lambda w, i: F.when(w.isin(SLOT, VOID, BLANK, "<status>"), F.concat(i.cast("string"), w))), lambda w: w.isNotNull())
    return F.concat_ws(" ", F.size(words).cast("string"), F.concat_ws(" ", F.transform(F.slice(words, 1, DEPTH), variable)), F.concat_ws(" ", special))


_telling = lru_cache(100_000)(concepts.telling)


class _Leaf:
    """The templates of one leaf; units of the leaf join the most similar one that has the same telling words.

    A unit that shares enough positions with a template shares one of the first
    few after the prefix, whichever they are: only templates found under one of
    those are compared, so that a leaf of many templates takes linear time.
    """

    def __init__(self) -> None:
        self.templates: list[list[str]] = []
        self.exemplars: list[str] = []
        self.at: dict[tuple, list[int]] = {}

    def place(self, unit: str, exemplar: str) -> int:
        words = [w.rstrip(".,;!") or w for w in unit.split(" ")]
        n = len(words)
        needed = -(-SIMILAR * n // 1)
        told = tuple(w for w in words if _telling(w))
        probes = int(n - needed + 1)
        where = range(DEPTH, DEPTH + probes) if DEPTH + probes <= n else range(n)
        keys = [(told, k, words[k]) for k in where if words[k] != WILD]
        best, most = -1, needed
        for c in sorted({c for key in keys for c in self.at.get(key, ())}):
            same = sum(a == b for a, b in zip(self.templates[c], words))
            if same >= most and (same > most or best < 0):
                best, most = c, same
        if best < 0:
            best = len(self.templates)
            self.templates.append(words)
            self.exemplars.append(exemplar)
            for key in keys:
                self.at.setdefault(key, []).append(best)
        else:
            self.templates[best] = [a if a == b else WILD for a, b in zip(self.templates[best], words)]
        return best


def _mined(batches: Iterator[pd.DataFrame], text: str) -> Iterator[tuple[str, list[str], list[str], list[str]]]:
    """Mines the ``text`` of rows sorted by part, which may go on in the next batch: part, texts, their templates and exemplars."""
    part, leaf, texts, at = None, _Leaf(), [], []

    def done() -> tuple[str, list[str], list[str], list[str]]:
        whole = [" ".join(t) for t in leaf.templates]
        return part, texts, [whole[k] for k in at], [leaf.exemplars[k] for k in at]

    for pdf in batches:
        for p, t, e in zip(pdf["part"], pdf[text], pdf["exemplar"] if "exemplar" in pdf else pdf[text]):
            if p != part:
                if texts:
                    yield done()
                part, leaf, texts, at = p, _Leaf(), [], []
            texts.append(t)
            at.append(leaf.place(t, e))
    if texts:
        yield done()


def _framed(columns: list[str], rows: Iterator[list[list]]) -> Iterator[pd.DataFrame]:
    """Lists of columns as frames of 5,000 rows or more; there are many small parts."""
    held: list[list] = [[] for _ in columns]
    for lists in rows:
        for h, x in zip(held, lists):
            h += x
        if len(held[0]) >= 5000:
            yield pd.DataFrame(dict(zip(columns, held)))
            held = [[] for _ in columns]
    if held[0]:
        yield pd.DataFrame(dict(zip(columns, held)))


def _first_pass(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = ([[part.split("\u0001", 1)[1]] * len(texts), texts, found, exemplars] for part, texts, found, exemplars in _mined(batches, "unit"))
    yield from _framed(["leaf", "unit", "first", "exemplar"], rows)


def _second_pass(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def rows() -> Iterator[list[list]]:
        for part, texts, found, exemplars in _mined(batches, "first"):
            kinds = {e: concepts.candidate(e) for e in set(exemplars)}
            yield [[part] * len(texts), texts, found, exemplars, [kinds[e] for e in exemplars]]

    yield from _framed(["leaf", "first", "template", "exemplar", "kind"], rows())


def templates(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mines the templates of all units.

    First: leaf, unit and first (its template within its part), a row for each
    distinct unit. Second: leaf, first, template, exemplar (one of its units)
    and kind, a row for each template of a part; kind is what the exemplar is a
    candidate for, null for an ordinary one. What comes out depends on the
    units alone, not on their number of partitions.
    """
    counted = units.select("unit").distinct().withColumn("leaf", _leaf(F.split("unit", " ")))
    parts = counted.select("unit", F.concat(F.pmod(F.xxhash64("unit"), F.lit(SALTS)).cast("string"), F.lit("\u0001"), "leaf").alias("part"))
    once = parts.repartition("part").sortWithinPartitions("part", "unit").mapInPandas(_first_pass, "leaf string, unit string, first string, exemplar string")
    first = stored(once, "first")
    merged = first.groupBy("leaf", "first").agg(F.min("exemplar").alias("exemplar")).select(F.col("leaf").alias("part"), "first", "exemplar")
    merged = merged.repartition("part").sortWithinPartitions("part", "first")
    second = stored(merged.mapInPandas(_second_pass, "leaf string, first string, template string, exemplar string, kind string"), "second")
    return first.select("leaf", "unit", "first"), second


# ------------------------------------------------------------------ verdicts


def _with_voids(second: DataFrame) -> DataFrame:
    """Candidates whose void value stands where another template has a slot are slots; other voids are ordinary."""
    flat = F.regexp_replace("template", f"{SLOT}|{VOID}|{BLANK}", "<value>")
    candidates = cut(second.filter("kind is not null").withColumn("flat", flat))
    slots = candidates.filter("kind = 'slot'").select("flat").distinct()
    voids = lookup_join(candidates.filter("kind = 'void'"), slots, ["flat"], "left_semi", salt_by="first")
    return candidates.filter("kind <> 'void'").unionByName(voids.withColumn("kind", F.lit("slot"))).drop("flat")


def judged(units: DataFrame, first: DataFrame, second: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The verdicts on templates, and where they are met.

    First: leaf, template, kind, mails (that show it), alone (how many of these
    say less than ``AMID`` sentences besides) and verdict, null for speech.
    Second: doc_id, kind and others (sentences said besides), a row for each
    document and kind that a template with a verdict gives it.
    """
    kinds = _with_voids(second).select("leaf", "first", "template", "exemplar", "kind")
    flagged = cut(lookup_join(first, kinds, ["leaf", "first"], salt_by="unit").select("unit", "leaf", "template", "exemplar", "kind"))
    met = lookup_join(units, flagged, ["unit"], salt_by="mail")
    # a mail's candidates lie together, and what it says besides is all but the paragraphs that hold one
    key = ["leaf", "template", "exemplar", "kind"]
    by_mail = met.groupBy("doc_id", "mail").agg(F.max("total").alias("total"), F.collect_set(F.struct("para", "said")).alias("paras"), F.collect_set(F.struct(*key)).alias("shown"))
    others = F.col("total") - F.aggregate("paras", F.lit(0), lambda n, p: n + p["said"])
    shown = stored(by_mail.select("doc_id", "mail", others.alias("others"), F.inline("shown")), "shown")
    evidence = shown.groupBy(*key).agg(F.count("*").alias("mails"), F.count_if(F.col("others") < AMID).alias("alone"))
    speaks = F.col("kind").isin("error", "scripts") & (F.col("alone") < F.col("mails") * ALONE)
    verdicts = cut(evidence.withColumn("verdict", F.when(~speaks, F.col("kind"))))
    held = lookup_join(shown, verdicts.filter("verdict is not null").select(*key), key, "left_semi", salt_by="mail")
    return verdicts, held.select("doc_id", "kind", "others")


def residue(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id and kind (slot, filler, error or scripts), a row for each mail and kind it shows.

    The verdicts on templates go to their units and from those to the mails. A
    mail that says ``AMID`` sentences or more besides isn't an error page or a
    notice. Copies of a case are cases; null and empty texts are none. Ids may
    repeat; a null id comes out as such.
    """
    units = stored(unit_rows(documents, doc_id, text), "units")
    _, held = judged(units, *templates(units))
    return held.filter(F.col("kind").isin("slot", "filler") | (F.col("others") < AMID)).select("doc_id", "kind").distinct()


def template_report(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """template, kind (ordinary where there is no verdict), units (distinct) and occurrences."""
    units = stored(unit_rows(documents, doc_id, text), "units")
    first, second = templates(units)
    verdicts, _ = judged(units, first, second)
    said = lookup_join(second.select("leaf", "first", "template", "exemplar"), verdicts.select("leaf", "template", "exemplar", "verdict"), ["leaf", "template", "exemplar"], "left", salt_by="first")
    both = first.join(said, ["leaf", "first"]).join(units.groupBy("unit").agg(F.count("*").alias("n")), "unit")
    return both.groupBy("template", F.coalesce("verdict", F.lit("ordinary")).alias("kind")).agg(F.count("*").alias("units"), F.sum("n").alias("occurrences"))
