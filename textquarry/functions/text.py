"""Scalar text functions as column expressions.

Lengths count code points; white space is Unicode's, as with Python's str.strip.
All of these stay inside the JVM.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, month names, templates and limits that results depend on.
RE_ARTICLE = r"(?:^|\n)#{0,6}\s*\**\s*Art(?:igo)?\.?\s*(\d+)[\.\-]?\s*[º°oO]?(?:[\-–][A-Z])?"
RE_NUMBER = r"(\d+(?:-[A-Za-z]+)?/\d{4})"
RE_DATE = r"\bde\s+(\d{1,2})\s+de\s+([A-Za-zçÇãõéêáíóú]+)"
RE_SUMMARY = r"Sumário:\s*(.+?)(?:\n|$)"
RE_ENTITY = r"entidade adjudicante:\s*(.+)"
RE_CITATION = r"(?:decreto[\s\-]lei|decreto|lei|portaria|despacho|regulamento|aviso|resolução)\s*(?:n\.?\s*[º°]?\s*)?(\d+(?:-[A-Za-z]+)?/\d{4})"
RE_SECTION = r"(?:^|\n)\s*(\d+(?:\.\d+)?)\s*[-–]\s+([A-ZÀ-Ú][^\n]{3,80})"
MONTHS = {
    "janeiro": 1, "fevereiro": 2, "março": 3, "marco": 3, "abril": 4, "maio": 5, "junho": 6,
    "julho": 7, "agosto": 8, "setembro": 9, "outubro": 10, "novembro": 11, "dezembro": 12,
}
TARGET_TYPES = ["Aviso", "Despacho", "Portaria", "Decreto", "Deliberação", "Edital", "Louvor"]
QUESTION_TEMPLATES = [
    "Que {tipo_l} do Diário da República trata de: {sumario}?",
    "Identifique o {tipo_l} que tem como objeto: {sumario}.",
    "Qual o {tipo_l} relativo a: {sumario}?",
]
SUMMARY_HEAD, SUMMARY_CUT, ENTITY_CUT = 500, 200, 100

#: Case-insensitive with Unicode rules, only \n ends a line.
ANY_CASE, UNICODE = "(?idU)", "(?dU)"
SPACE = r"[\s\x1c-\x1f]"


def let(value: Column, f) -> Column:
    """f of a value that is worked out once: a column named inside a lambda is worked out again for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


#: All that SPACE matches with (?U).
_SPACES = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_SPACES))


def collapse(c: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return strip(F.regexp_replace(c, rf"(?U){SPACE}+", " "))


def _first(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, which holds a character at least; null where nothing matches."""
    return F.get(F.filter(F.array(F.regexp_extract(c, pattern, group)), lambda x: x != ""), F.lit(0))


def parse_title(title: Column) -> Column:
    """struct(tipo, numero, data_publicacao); unknown parts are '' and tipo '?'."""
    t = F.coalesce(title, F.lit(""))
    kind = F.regexp_extract(t, rf"(?U)^{SPACE}*([^\s\x1c-\x1f]+)", 1)
    number = F.regexp_extract(t, UNICODE + RE_NUMBER, 1)
    day = F.regexp_extract(t, ANY_CASE + RE_DATE, 1)
    names = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    month = F.try_element_at(names, F.lower(F.regexp_extract(t, ANY_CASE + RE_DATE, 2)))
    known = (number != "") & month.isNotNull()
    date = F.when(known, F.concat(F.element_at(F.split(number, "/"), -1), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(day.try_cast("int").cast("string"), 2, "0")))
    return F.struct(F.when(kind == "", "?").otherwise(kind).alias("tipo"), number.alias("numero"), F.coalesce(date, F.lit("")).alias("data_publicacao"))


def summary(text: Column) -> Column:
    """The summary line within the first 500 characters, or null."""
    return _first(F.substring(text, 1, SUMMARY_HEAD), ANY_CASE + RE_SUMMARY)


def question_summary(text: Column) -> Column:
    """The summary, collapsed and without final dots, as questions use it."""
    return F.regexp_replace(collapse(summary(text)), r"\.+\z", "")


def frontmatter(kind: Column, number: Column, date: Column, text: Column) -> Column:
    """struct(tipo, numero, data, sumario, entidade); the last two null where not found."""
    return F.struct(
        kind.alias("tipo"),
        number.alias("numero"),
        date.alias("data"),
        F.substring(collapse(summary(text)), 1, SUMMARY_CUT).alias("sumario"),
        F.substring(collapse(_first(text, ANY_CASE + RE_ENTITY)), 1, ENTITY_CUT).alias("entidade"),
    )


def citations(text: Column, own: Column) -> Column:
    """Sorted distinct numbers that a text cites, its own left out."""
    found = F.regexp_extract_all(text, F.lit(ANY_CASE + RE_CITATION), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x != own)))


def enriched(fm: Column, text: Column) -> Column:
    """The text below a header of its frontmatter; empty parts are left out."""

    def part(label: str, c: Column) -> Column:
        return F.when(c != "", F.concat(F.lit(label), c))

    head = F.concat_ws(
        " | ", F.concat(F.lit("Tipo: "), fm["tipo"]), part("Número: ", fm["numero"]), part("Entidade: ", fm["entidade"]), part("Assunto: ", fm["sumario"])
    )
    return F.concat(head, F.lit("\n\n"), text)


def source_block(kind: Column, number: Column, text: Column) -> Column:
    return F.concat(F.lit("--- FONTE ("), kind, F.lit(" "), number, F.lit(") ---\n"), text)


def prompt(context: Column, question: Column) -> Column:
    return F.concat(F.lit("CONTEXTO LEGAL:\n"), context, F.lit("\n\nPERGUNTA: "), question)


# A fixed value: the rules that every model is given.
SYSTEM_PROMPT = (
    "És um assistente jurídico especializado em legislação portuguesa. "
    "Responde EXCLUSIVAMENTE com base no contexto fornecido. "
    "Se a informação não estiver no contexto, diz explicitamente que "
    "não encontraste essa informação nos documentos disponíveis. "
    "Cita sempre o artigo e diploma de onde retiras a informação."
)


def qa_prompt(context: Column, question: Column) -> Column:
    """One prompt with the rules in it."""
    return F.concat(F.lit(f"SISTEMA: {SYSTEM_PROMPT}\n\nCONTEXTO LEGAL:\n-----\n"), context, F.lit("\n-----\n\nPERGUNTA: "), question, F.lit("\n\nRESPOSTA:"))


def messages(text: Column, system: str | None = SYSTEM_PROMPT) -> Column:
    """The messages of a chat as JSON text: the rules, if any, and the prompt."""
    one = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.to_json(F.array(*([one("system", F.lit(system))] if system else []), one("user", text)))


def token_estimate(text: Column) -> Column:
    """Tokens by length where no tokenizer is at hand: a quarter of the characters, 1 at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def point_id(chunk_id: Column) -> Column:
    """The first 60 bits of the MD5 of a chunk's id."""
    return F.conv(F.substring(F.md5(chunk_id.cast("binary")), 1, 15), 16, 10).cast("bigint")


def query_prefixed(text: Column) -> Column:
    return F.concat(F.lit("query: "), text)


def passage_prefixed(text: Column) -> Column:
    return F.concat(F.lit("passage: "), text)


def article_numbers(text: Column) -> Column:
    """Numbers of article headings in order; over 38 digits become null."""
    found = F.regexp_extract_all(text, F.lit(ANY_CASE + RE_ARTICLE), F.lit(1))
    return F.transform(found, lambda x: x.try_cast("decimal(38,0)"))


def section_headings(text: Column) -> Column:
    """Numbers of level-1 section headings (no dot in the number)."""
    found = F.regexp_extract_all(text, F.lit(UNICODE + RE_SECTION), F.lit(1))
    return F.filter(found, lambda x: ~x.contains("."))


def json_object(text: Column) -> Column:
    """The first JSON object in a text as a variant: from the first { to the last }, then without fences."""
    body = _first(text, r"(?s)\{.*\}", 0)
    return F.coalesce(F.try_parse_json(body), F.try_parse_json(strip(F.regexp_replace(body, "```json|```", ""))))


def judge_scores(text: Column, reasoning: Column | None = None) -> Column:
    """struct(faithfulness, answer_relevancy, correctness) of a judge's answer; null unless all three are there."""
    data = json_object(text) if reasoning is None else F.coalesce(json_object(text), json_object(reasoning))
    got = [F.try_variant_get(data, f"$.{k}", "double") for k in ("fidelidade", "relevancia", "correcao")]
    whole = got[0].isNotNull() & got[1].isNotNull() & got[2].isNotNull()
    return F.when(whole, F.struct(got[0].alias("faithfulness"), got[1].alias("answer_relevancy"), got[2].alias("correctness")))


def question_text(kind: Column, summary_: Column, index: Column) -> Column:
    """A question from the template that the index chooses."""
    template = F.element_at(F.array(*[F.lit(t) for t in QUESTION_TEMPLATES]), (F.pmod(index, F.lit(len(QUESTION_TEMPLATES))) + 1).cast("int"))
    return F.replace(F.replace(template, F.lit("{tipo_l}"), F.lower(kind)), F.lit("{sumario}"), summary_)


def question_id(kind: Column, index: Column) -> Column:
    number = index.cast("string")
    return F.concat(F.lit("ID_"), F.upper(F.substring(kind, 1, 3)), F.lit("_"), F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number))


def fingerprint(config: dict) -> str:
    """16 hex digits of a configuration, whatever the order of its keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:16]
