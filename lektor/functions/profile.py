"""What a package calls things: vocabularies, house rules and thresholds, with overlays.

The values are fixed: results depend on them. ``merged`` lays another profile over this one; ``load`` reads one from JSON.
"""

from __future__ import annotations

import json
import re

# Names, word lists and thresholds.
PROFILE: dict = {
    "path_patterns": {"chapter": r"(?i)(?:chapter|chpater|chapt\w*)[-_ ]*(\d+)", "lesson": r"(?i)lesson[-_ ]*(\d+)"},
    "lesson_plan_sections": {
        "introduction": ["Introduction", "تعارف"],
        "slos": ["SLOs", "Student Learning Outcomes", "Learning Outcomes", "Student Learning Objectives", "Learning Objectives", "حاصلات تعلیم"],
        "warm_up": ["Warm-up", "Warm up", "Warmup", "تحریکی سرگرمی"],
        "concept_building": ["Concept Building", "تصوراتی تعمیر"],
        "key_takeaways": ["Key Takeaways", "حاصل کلام"],
    },
    "vocab": {
        "question_prefixes": ["question", "q", "سوال", "سوال نمبر"],
        "lesson_heading_prefixes": ["lesson", "سبق"],
        "chapter_ordinals": {1: ["اول", "first", "one"], 2: ["دوم", "second", "two"], 3: ["سوم", "third", "three"], 4: ["چہارم", "fourth", "four"], 5: ["پنجم", "fifth", "five"], 6: ["ششم", "sixth", "six"], 7: ["ہفتم", "seventh", "seven"], 8: ["ہشتم", "eighth", "eight"], 9: ["نہم", "ninth", "nine"], 10: ["دہم", "tenth", "ten"]},
        "question_region_end_labels": ["اساتذہ", "Teacher", "Facilitator", "رہنمائے", "تشخیصی رہنمائی", "Answer Key", "Marking guide", "جوابات", "Guidance"],
        "fg_section_labels": {"slos": ["Session Overview", "Lesson SLOs", "Lesson at a glance", "سیشن کا جائزہ", "سیشن کا خلاصہ", "سبق پر ایک نظر"], "key_takeaways": ["Recap", "Summary", "خلاصہ", "اعادہ"]},
        "appendix_headings": ["Book and SLO Coverage", "Book & SLO Coverage", "کتاب اور SLO", "کتاب اور حاصلات", "References", "Reference List", "حوالہ جات"],
        "facilitator_note_labels": ["Facilitator Notes", "Facilitator Note", "Facilitator tip", "Teacher note", "مقرر کے لیے نوٹ", "مقرر کے لیے مشورہ"],
        "reference_list_labels": ["References", "Reference List", "Bibliography", "حوالہ جات"],
        "slo_tag_patterns": [r"\bSLO\b", "حاصلات? ?تعلیم", r"[A-Z]-\d{2}-[A-Z]-\d{2}"],
        "lesson_plan_location_labels": ["Lesson Plan Location", "سبق کے منصوبے میں مقام"],
        "feedback_labels": ["Correct feedback", "Incorrect feedback", "درست فیڈبیک", "غلط فیڈبیک"],
        "answer_key_labels": ["Answer Key", "Answers", "جوابات", "جواب نامہ", "کلید جوابات"],
        "slo_sublabels": ["Knowledge", "Skills", "Skill", "Attitude", "Values", "علم", "صلاحیت", "صلاحیتیں", "رویہ", "رویے", "اقدار"],
        "slo_lead_ins": ["By the end", "At the end", "Students will be able to", "اس سبق کے اختتام", "سبق کے اختتام پر", "اس سبق کو پڑھنے کے بعد", "اس سبق کو پڑھن"],
        "slo_block_end_labels": ["Note", "Notes", "Instruction", "Instructions", "For teachers", "Teacher", "نوٹ", "ہدایت", "ہدایات", "برائے اساتذہ", "اساتذہ کے لیے", "طلبہ کے لیے"],
        "answer_line_labels": ["Answer", "Model answer", "Sample answer", "Hint", "مثالی جواب", "جواب", "اشارہ"],
        "caption_prefixes": {"table": ["Table", "جدول"], "figure": ["Figure", "Fig.", "شکل"]},
        "mcq_types": ["کثیر الانتخابی سوال", "MCQ", "Multiple choice", "Multiple choice question"],
        "higher_order_words": ["higher", "analy", "evaluat", "creat", "critical", "reasoning", "تجزیہ", "تجزی", "تنقیدی", "تخلیقی", "جائزہ", "فیصلہ", "اعلیٰ", "استدلال", "خود احتساب", "منصوبہ بندی"],
        "lower_order_words": ["lower", "remember", "understand", "apply", "fidelity", "recall", "یاد", "فہم", "سمجھ", "اطلاق", "کتابی", "معروضی", "وضاحت"],
        "lower_order_levels": ["یاد کرنا", "سمجھنا", "اطلاق", "Remember", "Understand", "Apply"],
        "data_bank_fields": {"chapter_lesson": ["باب / سبق", "Chapter / Lesson"], "subject": ["مضمون", "Subject"], "chapter": ["باب", "Chapter"], "lesson": ["سبق", "Lesson"], "slo": ["حاصلات تعلیم", "SLO", "SLO Code", "SLOs"], "question_type": ["قسم سوال", "Question type", "Type"], "level": ["سطح", "Level"], "question": ["سوال / محرک", "Question"], "options": ["اختیارات / تعامل کا مواد", "Options"], "answer": ["مثالی جواب", "Answer", "Correct answer"], "feedback_correct": ["درست جواب کا فیڈبیک", "Correct feedback"], "feedback_incorrect": ["غلط جواب کا فیڈبیک", "Incorrect feedback"]},
        "coverage_headers": ["Book Heading", "Lesson Plan Location", "SLO", "Possible Lottie", "کتاب کا عنوان", "سبق کا مقام", "حاصلات تعلیم", "لوٹی"],
        "coverage_titles": ["Book and SLO Coverage", "کتاب اور SLO"],
        "glossary_labels": ["Glossary Terms", "Glossary", "فرہنگ", "اصطلاحات", "مشکل الفاظ"],
        "all_or_none": ["all of the above", "none of the above", "مذکورہ بالا تمام", "مندرجہ بالا تمام", "ان میں سے کوئی نہیں", "مذکورہ بالا میں سے کوئی نہیں", "تمام درست ہیں"],
        "note_items": {
            "how to explain": ["how to explain", "analogy", "example", "demonstrat", "سمجھا", "تمثیل", "مثال", "وضاحت"],
            "check for understanding": ["check for understanding", "check-for-understanding", "show of hands", "poll", "quick question", "فہم کی جانچ", "ہاتھ اٹھوا", "رائے شماری"],
            "misconceptions": ["misconception", "common mistake", "غلط فہمی"],
            "supporting media cue": ["video", "simulation", "game", "media", "ویڈیو", "سیمولیشن", "گیم", "میڈیا"],
            "transition line": ["transition", "bridge", "next concept", "ربط", "اگلے تصور", "آگے بڑھ"],
        },
        "storyboard_columns": {"scene": ["Scene", "Step", "منظر"], "duration": ["Duration", "دورانیہ"], "on_screen": ["On-Screen", "On Screen", "اسکرین"], "narration": ["Narration", "بیانیہ"], "visual": ["Animation", "Visual", "متحرک", "بصری"]},
        "storyboard_origin": ["new video", "new.", "edited from", "نیا", "ترمیم شدہ", "ماخوذ", "path a", "path b"],
        "duration_labels": ["duration", "دورانیہ", "total", "کل"],
        "title_stop_words": ["lesson", "سبق", "باب", "chapter", "part", "کی", "کا", "کے", "اور", "و", "میں", "سے", "کو", "پر", "ہے", "the", "of", "and", "a", "in", "to"],
        "honorifics": ["حضرت", "سیدنا", "امام", "Hazrat", "Prophet", "Imam"],
        "honorifics_after": ["رضی", "علیہ", "صلی", "ﷺ"],
        "extra_question_patterns": [],
    },
    "house_rules": {
        "urdu_fonts": ["Noto Nastaliq Urdu", "Noto Nastaliq"],
        "english_fonts": ["Poppins", "Montserrat"],
        "sizes_by_grade": [
            {"grades": [1, 5], "title": 20, "section_heading": 16, "body": 14, "table_body": 14, "table_header": 16, "caption": 11},
            {"grades": [6, 12], "title": 20, "section_heading": 14, "body": 12, "table_body": 12, "table_header": 14, "caption": 11},
        ],
        "default_grade": 6,
        "paragraph_space_after_pt": 8,
    },
    "thresholds": {"text_size_tolerance": 0.02, "min_image_dpi": 150, "duplicate_similarity": 0.85, "colour_grey_tolerance": 14},
}


def merged(base: dict, over: dict) -> dict:
    """``over`` laid on ``base``: dictionaries by key, learned question patterns added up, anything else replaced."""
    out = dict(base)
    for key, value in over.items():
        if key == "extra_question_patterns":
            out[key] = [*out.get(key, []), *[v for v in value if v not in out.get(key, [])]]
        else:
            out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def load(path: str | None = None) -> dict:
    if path is None:
        return PROFILE
    with open(path, encoding="utf-8") as f:
        return merged(PROFILE, json.load(f))


def save_pattern(path: str, pattern: str, note: str = "") -> None:
    """Add a learned question pattern to a profile file, once; one that doesn't compile is refused."""
    re.compile(pattern)
    try:
        with open(path, encoding="utf-8") as f:
            own = json.load(f)
    except FileNotFoundError:
        own = {}
    with open(path, "w", encoding="utf-8") as f:
        json.dump(merged(own, {"vocab": {"extra_question_patterns": [{"pattern": pattern, "note": note}]}}), f, ensure_ascii=False, indent=1)


def extra_patterns(profile: dict) -> list[str]:
    """The learned patterns that compile."""
    out = []
    for entry in profile["vocab"].get("extra_question_patterns", []):
        pattern = entry["pattern"] if isinstance(entry, dict) else entry
        try:
            re.compile(pattern)
        except re.error:
            continue
        out.append(pattern)
    return out


def lower(labels: list[str]) -> list[str]:
    return [x.lower() for x in labels]


def _any(labels: list[str]) -> str:
    return "(?:" + "|".join(re.escape(x.lower()) for x in labels) + ")"


def question_pattern(profile: dict, labelled: bool = False) -> str:
    """A question's start in a folded, lower-case line: label (if asked for, or anyway), number (group 1), separator."""
    label = rf"(?:{_any(profile['vocab']['question_prefixes'])}\s*[.:\-–—]?\s*)"
    return rf"(?s)^\s*{label}{'' if labelled else '?'}([0-9]{{1,3}})\s*(?:[-–—:.)\]۔{'(' if labelled else ''}]|\s-\s)\s*(?:\S.*)?$"


def cell_question_pattern(profile: dict) -> str:
    """In a table: label and number, without a separator."""
    return rf"^\s*{_any(profile['vocab']['question_prefixes'])}\s*[.:\-–—]?\s*([0-9]{{1,3}})\b"


def lesson_pattern(profile: dict) -> str:
    """``lesson 2 (a)``: number (group 1) and part (group 2)."""
    return rf"^\s*{_any(profile['vocab']['lesson_heading_prefixes'])}\s*([0-9]+)\s*(?:\(\s*([^)]*?)\s*\))?"


def caption_pattern(profile: dict, kind: str) -> str:
    return rf"^\s*{_any(profile['vocab']['caption_prefixes'][kind])}\s*([0-9]+)\s*[:：.\-–]"


def own_number_pattern(profile: dict) -> str:
    """A lesson's or chapter's heading, which carries its own number."""
    labels = profile["vocab"]["lesson_heading_prefixes"] + ["باب", "chapter", "unit", "یونٹ"]
    ordinals = [w for names in profile["vocab"]["chapter_ordinals"].values() for w in names]
    return rf"^{_any(labels)}\s*[:\-–]?\s*(?:[0-9]+|{_any(ordinals)})(?![\p{{L}}\p{{N}}_])"


def pages(spec: str, total: int) -> list[int]:
    """``1-5,9`` as page numbers within 1 to total, in the order given."""
    out = []
    for part in filter(None, (p.strip() for p in spec.split(","))):
        lo, _, hi = part.partition("-")
        out += [k for k in range(int(lo), int(hi or lo) + 1) if 1 <= k <= total]
    return out


def material_budget(context: int | None) -> int:
    """Characters of material that fit a model's context."""
    return 12000 if context is None else max(2500, min(12000, int((context - 1800) * 2.2)))
