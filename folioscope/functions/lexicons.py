"""Word lists, patterns and thresholds that the analyses use by default.

Everything here is a default value of some operator's parameter.
"""

from __future__ import annotations

# Vague terms, by language.
AMBIGUOUS_TERMS = (
    "appropriate", "appropriately", "adequate", "adequately", "sufficient", "sufficiently", "as necessary", "as needed", "if needed",
    "if necessary", "as required", "as appropriate", "periodically", "regularly", "routinely", "when required", "where applicable",
    "reasonable", "acceptable", "properly", "suitable", "appropriate manner", "in a timely manner", "as soon as possible", "asap", "etc",
    "and/or", "some", "several", "various", "approximately", "about", "roughly", "generally", "typically", "normally", "usually", "may be",
    "should be considered", "clean thoroughly", "as directed",
)
AMBIGUOUS_TERMS_ES = (
    "apropiado", "adecuado", "suficiente", "según sea necesario", "si es necesario", "periódicamente", "regularmente",
    "cuando sea necesario", "cuando corresponda", "razonable", "aceptable", "correctamente", "adecuadamente", "aproximadamente",
)
# What an author has to supply for each vague term (default: criterion).
AMBIGUITY_HINTS = {
    "method": ("appropriately", "properly", "adequately", "sufficiently", "as directed", "as appropriate"),
    "frequency": ("as necessary", "as needed", "as required", "periodically", "regularly", "routinely"),
    "trigger condition": ("if needed", "if necessary", "when required", "where applicable"),
    "time limit": ("in a timely manner", "as soon as possible", "asap"),
    "tolerance": ("approximately", "about", "roughly"),
    "applicable cases": ("generally", "typically", "normally", "usually"),
}
# Tokens after which a sentence goes on.
ABBREVIATIONS = (
    "no.", "fig.", "e.g.", "i.e.", "etc.", "vs.", "approx.", "min.", "max.", "sec.", "std.", "rev.", "ref.", "dr.", "mr.", "ms.", "cfr.",
    "vol.",
)
# Verbs that open a directive step.
IMPERATIVES = (
    "record", "verify", "confirm", "measure", "inspect", "check", "remove", "install", "open", "close", "start", "stop", "wait", "wipe",
    "spray", "don", "doff", "label", "reconcile", "document", "sign", "date", "adjust", "set", "press", "select", "enter", "review",
    "collect", "transfer", "load", "unload", "sanitize", "disinfect", "clean", "prepare", "calibrate", "ensure", "notify", "discard",
    "store", "seal", "connect", "disconnect", "attach", "weigh", "dispense", "mix", "filter", "incubate", "read", "count", "add",
    "monitor", "log", "affix", "scan", "reject", "quarantine", "release",
)
# Obligation words in their order of preference, and noun endings.
MODALS = ("must", "shall", "should", "will", "responsible for")
NOMINAL_SUFFIXES = ("tion", "sion", "ment", "ance", "ence", "ility", "ization", "isation")
# Fixed value: a form of "to be", at most two words, a word that ends like a participle.
PASSIVE_PATTERN = (
    r"\b(?:is|are|was|were|be|been being|been|being|shall be|must be|will be|has been|have been|had been)\b(?:\s+\w+){0,2}?\s+\b\w+"
    r"(?:ed|en|wn|ne|ung| built|made|done|set|put|kept|held|sent|shown|taken|given|written|drawn|known|worn|torn)\b"
)
# Patterns of ids, words, sections.
DOCUMENT_ID_PATTERN = r"SOP-[A-Z]{2,4}-\d{3}(?:-[A-Z]{2})?"
WORD_PATTERN = r"[A-Za-zÁÉÍÓÚÜÑáéíóúüñ']+"
SECTION_KINDS = {
    "purpose": "purpose",
    "scope": "scope",
    "responsibilities": "responsib",
    "procedure": "procedure|method|process|instruction",
    "references": "reference",
    "revision history": "revision",
}
SAFETY_WORDS = ("safety", "warning", "hazard", "caution", "seguridad", "advertencia", "precaucion", "peligro")
# House style.
HOUSE_HEADING, HOUSE_MODAL, VERB_FIRST_MIN, PASSIVE_MAX = "markdown", "must", 15.0, 1.5
# Corpus words that say nothing about a topic.
DOMAIN_STOP_WORDS = (
    "sop", "procedure", "procedures", "step", "steps", "shall", "must", "should", "will", "record", "records", "recorded", "ensure",
    "section", "document", "documented", "review", "reviewed", "responsible", "responsibility", "purpose", "scope", "reference",
    "references", "date", "version", "operator", "personnel", "qa", "per", "use", "used", "using", "following", "table", "form", "log",
)
# Citations in their order: pattern, name; {1} stands for the first group.
CITATION_PATTERNS = (
    (r"21\s*CFR\s*Part\s*11\b", "21 CFR Part 11"),
    (r"21\s*CFR\s*(?:Part\s*)?(\d{3}\.\d{1,3})\b", "21 CFR {1}"),
    (r"ICH\s*Q2\s*\(?R\s*2\)?", "ICH Q2(R2)"),
    (r"ICH\s*Q2\s*\(?R\s*1\)?", "ICH Q2(R1)"),
    (r"ICH\s*Q9\s*\(?R\s*1\)?", "ICH Q9(R1)"),
    (r"ICH\s*Q9(?!\s*\(?R)", "ICH Q9"),
    (r"ICH\s*Q10\b", "ICH Q10"),
    (r"ICH\s*Q7\b", "ICH Q7"),
    (r"EU\s*GMP\s*Annex\s*1\b(?!\d)", "EU GMP Annex 1"),
    (r"EU\s*GMP\s*Annex\s*15\b", "EU GMP Annex 15"),
    (r"Annex\s*1\b(?!\d)", "EU GMP Annex 1"),
    (r"Annex\s*15\b", "EU GMP Annex 15"),
    (r"USP\s*<\s*1058\s*>", "USP <1058>"),
    (r"USP\s*<\s*797\s*>", "USP <797>"),
    (r"USP\s*<\s*71\s*>", "USP <71>"),
    (r"USP\s*<\s*85\s*>", "USP <85>"),
    (r"ISO\s*14644-1(?:\s*:\s*(\d{4}))?", "ISO 14644-1"),
    (r"ISO\s*13408-1\b", "ISO 13408-1"),
    (r"PDA\s*TR-?\s*60\b", "PDA TR-60"),
    (r"PDA\s*TR-?\s*70\b", "PDA TR-70"),
    (r"GAMP\s*5\b", "GAMP 5"),
    (r"ISPE\s*Baseline\s*Guide[:\s].{0,20}?CIP", "ISPE Baseline Guide: CIP"),
    (r"ISPE\b.{0,20}?\bCIP\b", "ISPE Baseline Guide: CIP"),
)
# A version within 30 characters of a citation; names that others supersede.
VERSION_PATTERN = (
    r"(?:\b\d{4}\s*(?:revision|rev\.?|edition|ed\.?)?|(?:rev\.?|revision|edition)\s*\d{4}|:\s*\d{4}|\d(?:st|nd|rd|th)\s*ed(?:ition)?|\(?R\s*\d\)?)"
)
VERSION_REACH = 30
SUPERSEDED = {"ICH Q2(R1)": ("ICH Q2(R2)", "Q2(R1)"), "ICH Q9": ("ICH Q9(R1)", "Q9")}
SEVERITY = {"current": 0, "unknown": 1, "review": 2, "outdated": 3}
# Frequent words by which a language is told.
LANGUAGE_MARKS = {
    "en": (
        "the", "of", "and", "to", "in", "is", "are", "shall", "must", "be", "this", "that", "for", "with", "by", "as", "from", "procedure", "cleaning",
        "personnel", "per",
    ),
    "es": (
        "de", "la", "el", "los", "las", "que", "se", "debe", "deberan", "del", "para", "por", "con", "una", "un", "en", "y", "o", "procedimiento",
        "limpieza", "personal", "segun", "conforme",
    ),
}
