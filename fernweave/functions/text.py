"""Text functions as Column expressions: tokens, normal forms, ids, headers, excerpts, similarity of vectors."""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode word characters; Java's \w alone is ASCII.
WORD = r"[\p{L}\p{N}_]+"
UNICODE_SPACE = r"(?U)\s+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def strip(text: Column) -> Column:
    """Without any Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize_answer(text: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces."""
    plain = F.translate(F.lower(text), string.punctuation, "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"(?U)\b(a|an|the)\b", " "), UNICODE_SPACE, " "))


def normalize_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(strip(name)), UNICODE_SPACE, " ")


def entity_id(name: Column, kind: Column, knowledge_id: Column) -> Column:
    """The same for any case and spacing of the name, another for each knowledge base."""
    return F.sha2(F.concat(normalize_name(name), F.lit("|"), F.lower(strip(kind)), F.lit("|"), F.coalesce(knowledge_id.cast("string"), F.lit(""))), 256)


def memory_hash(text: Column) -> Column:
    return F.sha2(F.lower(strip(text)), 256)


def excerpt_window(content: Column, query: str, window: int = 800) -> Column:
    """The text around the first case-insensitive hit, snapped outwards to paragraph borders within half a
    window; "..." where it is cut; without a hit the first ``window`` characters."""
    half = window // 2
    hit = F.instr(F.lower(content), query.lower()) - 1
    n = F.length(content)
    start = F.greatest(F.lit(0), hit - half)
    end = F.least(n, hit + len(query) + half)
    # The last paragraph border before the start, and the next one from the end on, by code points.
    head = F.substring(content, F.lit(1), start)
    last = F.when(F.instr(head, "\n\n") > 0, F.length(head) - F.instr(F.reverse(head), "\n\n") - 1).otherwise(-1)
    new_start = F.when((last >= 0) & (start - last < half), last + 2).otherwise(start)
    tail = F.substring(content, end + 1, n)
    ahead = F.instr(tail, "\n\n") - 1
    new_end = F.when((ahead >= 0) & (ahead < half), end + ahead).otherwise(end)
    body = F.trim(F.regexp_replace(F.substring(content, new_start + 1, new_end - new_start), r"(?U)^\s+|\s+$", ""))
    cut = F.concat(F.when(new_start > 0, "...").otherwise(""), body, F.when(new_end < n, "...").otherwise(""))
    return F.when(hit >= 0, cut).otherwise(F.substring(content, 1, window))


def context_header(document: Column, kind: Column, page: Column, section: Column) -> Column:
    """Document | Type | Page | Section; what is missing is left out."""
    part = lambda label, c: F.when(c.isNotNull() & (c.cast("string") != ""), F.concat(F.lit(f"{label}: "), c.cast("string")))
    return F.concat_ws(" | ", part("Document", document), part("Type", kind), part("Page", page), part("Section", section))


def embedding_text(content: Column, contextualized: Column, questions: Column) -> Column:
    base = F.when(F.coalesce(contextualized, F.lit("")) != "", contextualized).otherwise(content)
    asked = F.concat(F.lit("\n\nQuestions this passage answers:\n"), F.array_join(questions, "\n"))
    return F.when(F.size(questions) > 0, F.concat(base, asked)).otherwise(base)


def chunk_label(name: Column, page: Column, section: Column) -> Column:
    where = F.when(page.isNull() | (page == 0), F.lit("Unknown page")).otherwise(F.concat(F.lit("Page "), page.cast("string")))
    tail = F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit(" - "), section)).otherwise("")
    return F.concat(F.lit("["), F.coalesce(name, F.lit("Unknown")), F.lit(" — "), where, tail, F.lit("]"))


def table_row_text(title: Column, columns: Column, row: Column) -> Column:
    """[title] col: value | ... in the order of the columns, missing values empty."""
    cells = F.transform(columns, lambda c: F.concat(c, F.lit(": "), F.coalesce(F.element_at(row, c), F.lit(""))))
    return F.concat(F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit("["), title, F.lit("] "))).otherwise(""), F.array_join(cells, " | "))


def context_string(properties: Column) -> Column:
    """k=v;k=v in the order of the keys, nulls left out, quoted where a value holds ; or =."""
    value = lambda v: F.when(v.rlike("[;=]"), F.concat(F.lit("'"), v, F.lit("'"))).otherwise(v)
    entries = F.array_sort(F.map_entries(F.map_filter(properties, lambda k, v: v.isNotNull())))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), value(e["value"]))), ";")


def relation_type(raw: Column, allowed: list[str]) -> Column:
    """Upper case with underscores; raises where it is none of the allowed."""
    name = F.upper(F.replace(raw, F.lit(" "), F.lit("_")))
    return F.when(name.isin(allowed), name).otherwise(F.raise_error(F.concat(F.lit("relation type not allowed: "), name)))


def first_matching_type(text: Column, rules: list[tuple[str, str]], category: Column) -> Column:
    """The type of the first rule whose pattern is found, else the category in lower case, else "entity"."""
    chain = reduce(lambda acc, r: acc.when(text.rlike(f"(?i){r[0]}"), F.lit(r[1])), rules, F.when(F.lit(False), F.lit("")))
    return chain.otherwise(F.coalesce(F.nullif(F.lower(category), F.lit("")), F.lit("entity")))


def first_keyword_relation(text: Column, keywords: list[tuple[str, str]], default: str | None) -> Column:
    chain = reduce(lambda acc, r: acc.when(F.lower(text).contains(r[0].lower()), F.lit(r[1])), keywords, F.when(F.lit(False), F.lit("")))
    return chain.otherwise(F.lit(default).cast("string"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """In double; null for a vector without length."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def folded(*parts: Column) -> Column:
    """The parts that aren't empty, a blank line between them: context, what situates a passage, the passage."""
    return F.concat_ws("\n\n", *[F.nullif(p, F.lit("")) for p in parts])


def pages_text(pages: Column) -> Column:
    """An array of (page_number, content) as one text, in page order, each under "[Page n]"."""
    return F.array_join(F.transform(F.array_sort(pages), lambda p: F.concat(F.lit("[Page "), p["page_number"].cast("string"), F.lit("]\n"), p["content"])), "\n\n")


def known_memories(texts: Column) -> Column:
    """An array of texts as JSON; "(none)" for an empty one."""
    return F.when(F.size(F.coalesce(texts, F.array().cast("array<string>"))) > 0, F.to_json(texts)).otherwise("(none)")


def fenced_prompt(context: Column, question: Column) -> Column:
    """Context and question, each between lines that name it, so that neither passes for the other."""
    block = lambda name, c: F.concat(F.lit(f"<{name}>\n"), c, F.lit(f"\n</{name}>"))
    return F.concat_ws("\n\n", block("context", F.coalesce(context, F.lit(""))), block("question", question))
