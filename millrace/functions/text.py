"""Text expressions. Offsets and lengths are bytes of UTF-8 throughout."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of letters and digits, and every other visible character, count as tokens.
TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, also inside of a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim(text: Column) -> Column:
    """Without Unicode white space at both ends (SQL trim() takes blanks only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def count_tokens(text: Column) -> Column:
    """Number of regular-expression tokens; 0 for empty or null text."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0))


def estimate_tokens(text: Column) -> Column:
    """Four bytes a token, rounded down; 0 for null."""
    return F.coalesce(F.floor(F.octet_length(text) / 4), F.lit(0)).cast("int")


def tail(text: Column, size: int) -> Column:
    """The longest end of whole characters of at most ``size`` bytes."""
    raw = F.encode(text, "utf-8")
    end = F.substring(raw, -size, size)
    lead = F.filter(F.array(*[F.lit(i) for i in range(1, 5)]), lambda i: (F.conv(F.hex(F.substring(end, i, F.lit(1))), 16, 10).cast("int").bitwiseAND(192) != 128))
    whole = F.decode(F.substring(end, F.coalesce(F.element_at(lead, 1), F.lit(1)), F.lit(size)), "utf-8")
    return F.when(F.octet_length(text) <= size, text).otherwise(whole)


def split_plain(text: Column, separator: str) -> Column:
    """Split at a literal separator, empty parts kept."""
    return F.split(text, "\\Q" + separator.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)


def sections(text: Column, separator: str = "\n\n") -> Column:
    """Parts at the separator; of a single part, lines; of a single line, sentences
    (split at a period and blank, the period kept on all but the last)."""
    first, lines, sentences = split_plain(text, separator), split_plain(text, "\n"), split_plain(text, ". ")
    dotted = F.transform(sentences, lambda s, i: F.when(i < F.size(sentences) - 1, F.concat(s, F.lit("."))).otherwise(s))
    return F.when(F.size(first) > 1, first).when(F.size(lines) > 1, lines).otherwise(dotted)


def trimmed_sections(text: Column, separator: str = "\n\n") -> Column:
    """Sections without white space at their ends, empty ones left out."""
    return F.filter(F.transform(sections(text, separator), trim), lambda s: s != "")


def is_separator_label(label: Column) -> Column:
    """Labels that mark a boundary: they name one or carry a begin or inside prefix."""
    low = F.lower(label)
    return low.contains("sep") | low.contains("boundary") | low.startswith("b-") | low.startswith("i-")


# --- labels -----------------------------------------------------------------

#: Names of entity types and what they are filed under.
CANONICAL_LABELS = {
    "PERSON": "PER", "PEOPLE": "PER",
    "ORGANIZATION": "ORG", "ORGANISATIONS": "ORG", "COMPANY": "ORG",
    "LOCATION": "LOC", "PLACE": "LOC", "GPE": "LOC",
    "MISCELLANEOUS": "MISC",
}

#: Marks around labels in prompts, by task.
LABEL_MARKS = {"entities": "<<ENT>>", "relations": "<<REL>>", "classification": "<<CLS>>"}
LABEL_END = "<<SEP>>"


def label_type(label: Column) -> Column:
    """A label without its one-letter prefix; empty for O and empty labels."""
    bare = F.when(F.substring(label, 2, 1) == "-", F.substring(label, 3, 1 << 30)).otherwise(label)
    return F.when((label == "O") | (label == ""), F.lit("")).otherwise(bare)


def canonical_label(label: Column) -> Column:
    """label_type() in capitals, long names of types replaced by short ones."""
    upper = F.upper(label_type(label))
    table = F.create_map(*[F.lit(x) for pair in CANONICAL_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, upper), upper)


def label_prompt(labels: Column, task: str = "entities") -> Column:
    """Every label between its task's mark and the end mark, run together."""
    mark = LABEL_MARKS.get(task, LABEL_MARKS["entities"])
    return F.array_join(F.transform(labels, lambda x: F.concat(F.lit(mark), x, F.lit(LABEL_END))), "")


def composite_labels(entities: Column, relations: Column) -> Column:
    """``entity::relation`` for each pair, entities first."""
    return F.flatten(F.transform(entities, lambda e: F.transform(relations, lambda r: F.concat(e, F.lit("::"), r))))


# --- prompts and clean-up of model output -----------------------------------


def hypothesis(template: Column, label: Column) -> Column:
    """The template with its first ``{}`` replaced by the label."""
    at = F.instr(template, "{}")
    filled = F.concat(F.substring(template, F.lit(1), at - 1), label, F.substring(template, at + 2, F.length(template)))
    return F.when(at > 0, filled).otherwise(template)


def question_prompt(answer: Column, context: Column) -> Column:
    return F.concat(F.lit("generate question: <hl> "), answer, F.lit(" <hl> "), context)


def strip_task(text: Column) -> Column:
    """Without one task mark at each end, trimmed after each step."""
    opened = trim(F.regexp_replace(trim(text), r"^<s_[a-zA-Z0-9_-]+>", ""))
    return trim(F.regexp_replace(opened, r"</s_[a-zA-Z0-9_-]+>$", ""))


def document_question(question: Column) -> Column:
    return F.concat(F.lit("<s_docvqa><s_question>"), question, F.lit("</s_question><s_answer>"))


def document_answer(text: Column) -> Column:
    """What stands before the first end-of-answer mark, trimmed."""
    return trim(F.substring_index(trim(text), "</s_answer>", 1))


def recover_lines(text: Column) -> Column:
    """New lines where a small letter, or a mark that ends a sentence, meets a capital."""
    return F.regexp_replace(trim(text), r"(?<=[\p{Ll}.!?])(?=\p{Lu})", "\n")


def clean_transcript(text: Column) -> Column:
    """Without ``<|...|>`` marks: leading ones with the space after them, then all others."""
    leading = F.regexp_replace(trim(text), r"(?s)^(?:<\|.*?\|>(?U:\s*))+", "")
    return trim(F.regexp_replace(leading, r"(?s)<\|.*?\|>", ""))


def grounding_prompt(caption: Column) -> Column:
    return F.concat(F.lit("<CAPTION_TO_PHRASE_GROUNDING>"), caption)


def region_text(text: Column) -> Column:
    """Text of an answer with regions: trimmed, its location marks left in."""
    return trim(text)


#: Tasks of the prompted reader, their short names and sentences.
READER_TASKS = {
    "<CAPTION>": ("<cap>", "What does the image describe?"),
    "<DETAILED_CAPTION>": ("<dcap>", "Describe in detail what is shown in the image."),
    "<MORE_DETAILED_CAPTION>": ("<ncap>", "Describe with a paragraph what is shown in the image."),
    "<OCR>": ("<ocr>", "What is the text in the image?"),
    "<OCR_WITH_REGION>": (None, "What is the text in the image, with regions?"),
    "<OD>": ("<od>", "Locate the objects with category name in the image."),
    "<DENSE_REGION_CAPTION>": ("<region_cap>", "Locate the objects in the image, with their descriptions."),
    "<REGION_PROPOSAL>": ("<proposal>", "Locate the region proposals in the image."),
    "<CAPTION_TO_PHRASE_GROUNDING>": ("<grounding>", None),
}


def reader_task(name: Column) -> Column:
    """The task that a token or its short name stands for; null for others."""
    pairs = [(k, k) for k in READER_TASKS] + [(s, k) for k, (s, _) in READER_TASKS.items() if s]
    return F.try_element_at(F.create_map(*[F.lit(x) for p in pairs for x in p]), name)


def reader_prompt(task: Column) -> Column:
    """The sentence that a task token stands for, else the token."""
    pairs = [(k, p) for k, (_, p) in READER_TASKS.items() if p]
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in pairs for x in p]), task), task)
