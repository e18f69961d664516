"""Text pipeline: chunks, cleaning, shingles, near duplicates, evidence."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def word_chunks(docs: DataFrame, key: str, text: str, size: int = 512, overlap: int = 50) -> DataFrame:
    """Windows of words: key, chunk (from 0), body. A text of at most size words is one untouched chunk; the
    last window may lie wholly in the one before it."""
    words = F.split(F.trim(F.regexp_replace(F.col(text), "[ \\t\\n\\r\\f]+", " ")), " ")
    n = F.size("__w")
    starts = F.sequence(F.lit(0), n - 1, F.lit(size - overlap))
    # the words are a column of their own, so that they are not split anew for every chunk
    chunks = F.when(n <= size, F.array(F.col(text))).otherwise(F.transform(starts, lambda s: F.array_join(F.slice("__w", s + 1, size), " ")))
    return docs.where(F.col(text).isNotNull()).withColumn("__w", words).select(key, F.posexplode(chunks).alias("chunk", "body"))


def clean_body(text: Column) -> Column:
    """Without lines that are only links; all other text stays."""
    lines = F.filter(F.split(text, "\r?\n|\r"), lambda x: ~x.rlike(r"^\s*(?:\[[^\]]*\]\([^)]*\)\s*)+$"))
    return F.regexp_replace(F.array_join(lines, "\n"), r"^\s+|\s+$", "")


def prose_blocks(cleaned: Column, least_block: int = 45) -> Column:
    """The number of lines of so many characters; blocks end at any run of line ends."""
    return F.size(F.filter(F.split(cleaned, "\n+"), lambda x: F.length(F.trim(x)) >= least_block))


def body_quality(cleaned: Column, least_chars: int = 400, least_paragraphs: int = 2) -> Column:
    return (F.length(cleaned) >= least_chars) & (prose_blocks(cleaned) >= least_paragraphs)


_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")


def markdown_segments(text: str) -> list[str]:
    """Sentences of the paragraphs, without heading marks, each on one line."""
    out: list[str] = []
    for paragraph in re.split(r"\n\s*\n", text.strip()):
        line = re.sub(r"^#{1,6}\s+", "", paragraph.strip()).replace("\n", " ")
        out += [s.strip() for s in _SENTENCE_END.split(line) if s.strip()]
    return out


def markdown_chunks_of(text: str, limit: int = 2600, overlap: int = 400) -> list[str]:
    """Sentences of paragraphs, filled greedily up to ``limit`` characters, a space after each counted; a chunk starts
    with the last whole sentences of the one before, as many as fit into ``overlap`` characters with spaces between them. A
    sentence that is longer than the limit stays whole."""
    chunks: list[str] = []
    held: list[str] = []
    size = 0
    for s in markdown_segments(text):
        if held and size + len(s) + 1 > limit:
            chunks.append(" ".join(held))
            first, room = len(held), overlap
            while first and len(held[first - 1]) <= room:
                first -= 1
                room -= len(held[first]) + 1
            held = held[first:]
            size = sum(len(x) + 1 for x in held)
        held.append(s)
        size += len(s) + 1
    return [*chunks, " ".join(held)] if held else chunks


def markdown_chunks(docs: DataFrame, key: str, text: str, limit: int = 2600, overlap: int = 400) -> DataFrame:
    """markdown_chunks_of for each row: key, chunk, body."""
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, chunk int, body string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a batch has thousands of texts; few of them at a time are taken out of it and chunked
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                rows = [(k, i, c) for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) if t for i, c in enumerate(markdown_chunks_of(t, limit, overlap))]
                types = (part.schema.field(0).type, pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(types)], names=[key, "chunk", "body"])

    return docs.select(key, text).mapInArrow(run, schema)


def strip_data_uris(text: Column) -> Column:
    """Without embedded files."""
    return F.regexp_replace(text, r"data:[^, \t\n\r\f]*;base64,[A-Za-z0-9+/=]+", "")


def supersede(chunks: DataFrame, key: str, junk: Column) -> DataFrame:
    """Chunks without junk, numbered anew from 0. Embedded files are to be stripped before a text is cut into
    chunks (``strip_data_uris``), so that none is cut in two."""
    from pyspark.sql import Window

    kept = chunks.where(junk.isNull())
    return kept.withColumn("chunk", (F.row_number().over(Window.partitionBy(key).orderBy("chunk")) - 1).cast("int"))


def fulltext_outcome(chunks: Column, good: Column, words: Column) -> Column:
    """What became of a teaser: done, or why its body was left out."""
    return F.when(words < 80, "skipped_paywall").when((chunks == 0) | ~good, "skipped_lowquality").otherwise("done")


def context_window(text: Column, needle: Column, radius: int = 500, fallback: int = 1000) -> Column:
    """Characters around the first occurrence, else the beginning of the text."""
    at = F.instr(F.lower(text), F.lower(needle))
    start = F.greatest(at - radius, F.lit(1))
    return F.when(at > 0, F.substring(text, start, at + F.length(needle) + radius - start)).otherwise(F.substring(text, 1, fallback))


def evidence(rows: DataFrame, text: Column, limit: int = 700) -> DataFrame:
    """rows with an excerpt and its provenance: the class (canonical, or a legacy source by what the
    row holds: a notebook, a channel, or exactly one of the known sources) and the provider."""
    have = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    filled = lambda c: F.coalesce(have(c) != "", F.lit(False))
    source = F.lower(F.coalesce(have("source"), F.lit("")))
    handle = F.lower(F.regexp_replace(F.coalesce(have("telegram_channel"), F.lit("")), "^@+", ""))
    canonical = filled("source_type") & filled("provider")
    notebook, channel = have("notebook_id").isNotNull(), have("telegram_channel").isNotNull() | (source == "telegram")
    first = lambda *names: F.coalesce(*[F.when(filled(c), have(c)) for c in names])
    kind = F.when(canonical, "canonical").when(notebook, "notebooklm").when(channel, "telegram").when(source == "rss", "rss").when(source.isin("gdelt", "gdelt_gkg"), "gdelt").otherwise("unknown")
    provider = (
        F.when(canonical, have("provider")).when(notebook, F.concat(F.lit("notebooklm:"), have("notebook_id"))).when(channel & (handle != ""), F.concat(F.lit("telegram:"), handle)).when(channel, "telegram")
        .when(source == "rss", F.lower(F.coalesce(first("feed_name", "provider"), F.lit("rss")))).when(source.isin("gdelt", "gdelt_gkg"), F.lower(F.coalesce(first("source_name"), F.lit("gdelt")))).otherwise("?")
    )
    return rows.withColumns({"excerpt": F.substring(text, 1, limit), "provenance_class": kind, "provenance_provider": provider})


def report_sections(text: Column) -> Column:
    """Headings with their bullet lines, as (heading, bullets)."""
    blocks = F.filter(F.split(text, r"(?m)^#{1,6} "), lambda b: F.trim(b) != "")
    return F.transform(
        blocks,
        lambda b: F.struct(
            F.trim(F.substring_index(b, "\n", 1)).alias("heading"),
            F.transform(F.filter(F.split(b, "\n"), lambda x: x.rlike(r"^\s*[-*] ")), lambda x: F.trim(F.regexp_replace(x, r"^\s*[-*] ", ""))).alias("bullets"),
        ),
    )


#: Words of a question, the template that they ask for, in order, and whether it needs an entity.
INTENTS = [
    (("most connected", "top entities", "most important", "highest degree"), "top_connected", False),
    (("events involving", "events about", "events for"), "events_by_entity", True),
    (("timeline", "events in", "events at"), "event_timeline", False),
    (("co-occur", "appear together", "related entities", "co-occurring"), "co_occurring", True),
    (("sources for", "evidence", "reported by", "source"), "source_backed", True),
    (("network", "2-hop", "connections around"), "two_hop_network", True),
    (("operates", "operate", "betreibt", "in dienst", "im bestand", "fielded", "in service"), "one_hop", True),
    (("beschafft", "procures", "procurement", "modernisierung", "vorhaben", "contractor", "auftragnehmer"), "one_hop", True),
    (("connected to", "related to", "neighbors of", "linked to"), "one_hop", True),
    (("who is", "what is", "find entity", "look up"), "entity_lookup", True),
]


def asked_entity(question: Column) -> Column:
    """What stands in double quotes, else the words after the first that begin with a capital; null if none."""
    quoted = F.regexp_extract(question, '"([^"]+)"', 1)
    words = F.filter(F.split(question, r"[ \t\n\r\f]+"), lambda w: w != "")
    named = F.array_join(F.filter(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda w: w.rlike(r"^\p{Lu}")), " ")
    return F.when(quoted != "", quoted).when(named != "", named)


def intent(question: Column, entity: Column) -> Column:
    """The first template whose words are in the question and whose entity, if it needs one, is
    known; else the lookup of the entity; null without one. entity: asked_entity, a column of its own."""
    asked = F.lower(question)
    out = F.when(entity.isNotNull(), "entity_lookup")
    for marks, template, needs in reversed(INTENTS):
        found = asked.rlike("|".join(marks))
        out = F.when(found & entity.isNotNull() if needs else found, template).otherwise(out)
    return out


def asked_location(question: Column, entity: Column) -> Column:
    """Where a timeline is asked for: the entity, else what follows the last "in " or "at "."""
    rest = F.substring_index(F.substring_index(question, "in ", -1), "at ", -1)
    return F.coalesce(entity, F.btrim(rest, F.lit(" ?.")))


def sanitised(text: Column, fences: tuple[str, ...] = ("<<<GROUNDING_DATA", ">>>END_GROUNDING_DATA")) -> Column:
    """One line of outside text in which no fence can be forged."""
    out = F.regexp_replace(text, r"[ \t\n\r\f]+", " ")
    for fence in fences:
        out = F.replace(out, F.lit(fence), F.lit(re.sub("[<>]", "·", fence)))
    return F.trim(out)
