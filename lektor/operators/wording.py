"""Notes in everyday words, as columns; the code of the rule stays at the end in brackets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a note says, and what its reader does about it; the first that fits counts.
NOTES = [
    ("heading has no decimal number", "Number this heading (1, 1.1, 1.1.1)."),
    ("looks like a heading but uses the '.*?' style", "Use a Word heading style (Heading 1 or Heading 2) for this heading."),
    ("body text in the '.*?' style", "This is normal text: use the Normal style, not a heading style."),
    ("warm-up question beyond the third", "The warm-up should ask at most 3 questions. This one is extra."),
    ("numbered list item; use a bullet", "Use a bullet here instead of a number."),
    ("SLO item is .*?, should be a bullet", "Write this SLO as a bullet."),
    ("numbered; Key Takeaways are written as bullets", "Write the Key Takeaways as bullets, not numbers."),
    ("not a bullet; Key Takeaways are written as bullets", "Write the Key Takeaways as bullets."),
    ("Urdu text set left-to-right", "Set this Urdu text right-to-left."),
    ("colour used", "Remove the colour. Only black, white and grey are allowed."),
    ("has no 'Table N:' caption", "Add a title above this table, like 'Table 1: ...'."),
    ("has no 'Figure N:' caption|no 'Figure N:' caption below", "Add a caption under this picture, like 'Figure 1: ...'."),
    ("no alt text", "Add alt text to this picture: right-click it, then Edit Alt Text."),
    ("not a multiple-choice question", "Pop Quiz questions must be multiple choice."),
    ("no 'Lesson Plan Location' given", "Say where in the Lesson Plan this question appears (e.g. 'After 4.2 Liquids')."),
    ("no correct/incorrect feedback", "Add feedback for a correct answer and for a wrong answer."),
    ("correct answer is not highlighted yellow", "Highlight the correct answer in yellow."),
    ("question has no SLO tag", "Tag this question with the SLO it tests."),
    ("higher-order question", "Too many higher-order questions for this exam's mix."),
    ("lower-order question", "Too many lower-order questions for this exam's mix."),
    ("copied word for word from the Lesson Plan", "This slide copies the Lesson Plan word for word. Shorten it for the slide."),
]
# What to do about a whole document, by code; {n} is the first number of the message, {m} the message.
TODO = {
    "WE1": "Add the version to the file name, e.g. Lesson-Plan-Lesson-1-Chapter-1-v1.0.docx.",
    "WE3": "Add a version number to the file name, e.g. ...-v1.0.docx.",
    "WE17": "Add a caption under each picture, like 'Figure 1: ...'{n pictures}.",
    "WE18": "Some pictures are in colour. Use black-and-white or greyscale pictures{n found}.",
    "WE20": "Add alt text to the pictures (right-click a picture, then Edit Alt Text){n pictures}.",
    "LPG3": "Add the Book and SLO Coverage table at the end (columns: Book Heading, Lesson Plan Location, SLOs).",
    "LPG4": "If the lesson uses hard words, add a 'Glossary Terms' list at the end of Concept Building.",
    "WE15": "Add a table of contents if the file is longer than two pages.",
    "LP3": "Some Lesson Plan sections are missing or out of order: {m}.",
}
# Outputs whose codes go by another name.
OUTPUTS = {"CE": "Assessment", "WS": "Chapter Exam"}


def note_words(note: Column) -> Column:
    note = F.coalesce(note, F.lit(""))
    out = None
    for pattern, words in NOTES:
        hit = note.rlike("(?i)" + pattern)
        out = F.when(hit, words) if out is None else out.when(hit, words)
    return out.otherwise(F.concat(F.regexp_replace(note, r"\.+$", ""), F.lit(".")))


def count_words(message: Column, template: str) -> Column:
    """The template with the message's first whole number in it, or nothing."""
    n = F.regexp_extract(F.coalesce(message, F.lit("")), r"\b([0-9]+)\b", 1)
    before, _, after = template.partition("{}")
    return F.when(n != "", F.concat(F.lit(before), n, F.lit(after))).otherwise("")


def size_words(message: Column) -> Column:
    """``Body (12): 31% of text is wrong`` as an instruction."""
    pattern = r"([A-Za-z][A-Za-z ]*?) \(([0-9]+)( bold)?\): [0-9]+% of text is wrong"
    found = F.regexp_extract_all(F.coalesce(message, F.lit("")), F.lit(pattern), F.lit(0))
    part = lambda m, k: F.regexp_extract(m, pattern, k)
    said = F.transform(found, lambda m: F.concat(F.lower(F.trim(part(m, 1))), F.lit(" "), part(m, 2), F.lit(" pt"), F.when(part(m, 3) != "", ", bold").otherwise("")))
    return F.when(F.size(found) == 0, "Some text is not the size the guidelines ask.").otherwise(F.concat(F.lit("Some text is not the right size. It should be: "), F.array_join(said, "; "), F.lit(".")))


def output_name(code: Column) -> Column:
    prefix = F.regexp_replace(F.coalesce(code, F.lit("")), "[0-9]+$", "")
    return F.coalesce(*[F.when(prefix == k, v) for k, v in OUTPUTS.items()])


def named_code(code: Column) -> Column:
    name = output_name(code)
    return F.when(name.isNotNull(), F.concat(code, F.lit(" ("), name, F.lit(")"))).otherwise(code)


def tag(code: Column, name: Column | None = None) -> Column:
    named = code if name is None else F.concat_ws(" ", code, name)
    return F.when(F.coalesce(code, F.lit("")) != "", F.concat(F.lit(" ["), named, F.lit("]"))).otherwise("")


def _line(lead: str, words: Column, code: Column, name: Column | None) -> Column:
    return F.concat(F.lit(lead), words, tag(code, name))


def fail_line(code: Column, note: Column, name: Column | None = None) -> Column:
    return _line("To fix: ", note_words(note), code, name)


def check_line(code: Column, note: Column, name: Column | None = None) -> Column:
    return _line("Please check: ", note_words(note), code, name)


def pass_line(code: Column, note: Column, name: Column | None = None) -> Column:
    return _line("OK: ", note_words(note), code, name)


def todo_line(code: Column, message: Column, name: Column | None = None) -> Column:
    """What to do about a finding on a whole document."""
    message = F.coalesce(message, F.lit(""))
    out = F.when(code == "WE8", size_words(message)).when(code == "WE25", F.when(F.lower(message).contains("version"), "Add the version to the footer.").otherwise("Add a footer: name, version, date, page number."))
    for key, words in TODO.items():
        if "{m}" in words:
            said = F.concat(F.lit(words.split("{m}")[0]), message, F.lit(words.split("{m}")[1]))
        elif "{n " in words:
            head, _, rest = words.partition("{n ")
            unit, _, end = rest.partition("}")
            said = F.concat(F.lit(head), count_words(message, " ({} " + unit + ")"), F.lit(end))
        else:
            said = F.lit(words)
        out = out.when(code == key, said)
    return _line("To fix: ", out.otherwise(note_words(message)), code, name)


def model_line(code: Column, verdict: Column, reason: Column, first: Column, name: Column | None = None) -> Column:
    """What a model thinks, as something to decide; a repeated note is short."""
    reason = F.trim(F.coalesce(reason, F.lit("")))
    again = F.concat(F.lit("Same as the AI note above"), F.when((reason != "") & (verdict == "fail"), F.concat(F.lit(": "), reason)).otherwise("."), tag(code, name))
    fine = F.concat(F.lit("AI check, looks fine: "), reason, tag(code, name), F.lit("\nIf you agree, delete this note. If not, write what is missing."))
    bad = F.concat(F.lit("AI check, may need fixing: "), reason, tag(code, name), F.lit("\nIf you agree, fix it or tell the writer. If not, delete this note."))
    unclear = F.concat(F.lit("The AI could not decide this one. Please check it yourself."), tag(code, name))
    return F.when(~first, again).when(verdict == "pass", fine).when(verdict == "fail", bad).otherwise(unclear)


def fixed_line(words: Column) -> Column:
    return F.concat(F.lit("Fixed for you: "), words)


def source_note(note: Column) -> Column:
    """How a file was recognised."""
    kind = F.regexp_extract(note, "^Recognised as (.+?) (?:from its content|by the model)", 1)
    return F.when(kind != "", F.concat(F.lit("Treated as a "), F.initcap(kind), F.lit(", worked out from what is in the file."))).when(note.startswith("converted from"), "Converted from an old Word or PowerPoint file (.doc / .ppt).").otherwise(note)
