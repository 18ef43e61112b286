"""Plain versions of operators that SQL doesn't express, for small fixtures."""

import re

from sievework.operators import quality as Q


def analyse(text):
    """Features, subscores, overall, grade and issues of one text."""
    t = text or ""
    words, lines = t.split(), [x.strip() for x in t.split("\n") if x.strip()]
    out = {"words": len(words), "pages": max(1, round(len(words) / 400))}
    find = lambda p, flags=0: bool(re.search(p, t, flags))
    email, phone = find(Q.EMAIL), find(Q.PHONE)
    linked = find(Q.LINKEDIN, re.I) or find(Q.GITHUB, re.I)
    detected = [n for n, p in Q.SECTIONS.items() if find(p, re.I)]
    missing = [n for n in Q.SECTIONS if n not in detected]
    marked = [x for x in lines if x[0] in Q.BULLETS or re.match(r"\d+\.\s+", x)]
    symbols = list(dict.fromkeys(x[0] for x in marked if x[0] in Q.BULLETS))
    long_bullets = sum(len(x.split()) > 45 for x in marked)
    dense = sum(len(p.split()) > 65 and p.strip()[0] not in Q.BULLETS for p in t.split("\n\n"))
    spelled = [(w, Q.TYPOS[w]) for w in (re.sub(r"\W", "", x.lower()) for x in words) if w in Q.TYPOS][:4]
    grammar = [(f"{m[1]} {m[1]}", m[1]) for m in re.finditer(r"\b([a-zA-Z]{2,})\s+\1\b", t, re.I)]
    inside = False
    for x in lines:
        if any(w in x.lower() for w in Q.OPENS):
            inside = True
        elif any(w in x.lower() for w in Q.CLOSES):
            inside = False
        bare = re.sub(r"^[•\-*▪▫►✓\d.]+\s*", "", x).strip()
        verb = bare.split()[0].lower() if bare.split() else ""
        if inside and verb in Q.PAST:
            short = bare[:45] + "..." * (len(bare) > 45)
            grammar.append((short, f"{Q.PAST[verb].capitalize()} {short[len(verb) + 1 :]}".strip()))
            if len(grammar) >= 3:
                break
    grammar = grammar[:4]
    dates = [n for n, p in Q.DATES.items() if re.search(p, t)]
    between = lambda v, low: max(low, min(100, v))
    n = len(words)
    scores = {
        "ats_readability": between(85 - (45 if n < 150 else 20 if n < 300 or n > 1500 else 0) - (15 if dense > 2 else 5 if dense == 1 else 0) + (15 if len(marked) >= 8 else -25 if not marked else 0), 10),
        "formatting_layout": 90 - 15 * (out["pages"] > 2),
        "section_structure": between(40 + sum({"Contact Information": 15, "Work Experience / History": 25, "Skills & Competencies": 25, "Education & Qualifications": 15, "Summary / Objective": 10}.get(d, 0) for d in detected), 15),
        "bullet_quality": between((25 if not marked else 55 if len(marked) < 4 else 95 if len(marked) >= 8 else 80) - 15 * (len(symbols) > 1) - 10 * (long_bullets > 2), 20),
        "typography": 90,
        "grammar_spelling": between(92 - 12 * len(spelled) - 10 * len(grammar), 20),
        "consistency": between(88 - 15 * (len(symbols) > 1) - 15 * (len(dates) > 1), 25),
        "contact_information": 60 + 20 * email + 15 * phone + 5 * linked,
    }
    if n < 5:
        return out | dict.fromkeys(scores, 0) | {"overall": 0, "grade": "F", "problems": ["Unreadable or Empty Document Text"], "suggested": [], "n_good": 0}
    overall = max(10, min(100, round(sum(round(v * Q.WEIGHTS[k] * 100) for k, v in scores.items()) / 100)))
    grade = next((g for least, g in ((90, "A+"), (80, "A"), (70, "B"), (60, "C")) if overall >= least), "Needs Improvement")
    problems = ["Inconsistent bullet styles"] * (len(symbols) > 1) + ["Missing bullet points"] * (not marked) + ["Inconsistent date formatting"] * (len(dates) > 1)
    problems += ["Possible grammar/tense issue"] * len(grammar) + ["Spelling mistake detected"] * len(spelled) + ["Missing contact email"] * (not email) + ["Missing phone number"] * (not phone)
    problems += ["Excessive document length"] * (out["pages"] > 2) + [f"Missing standard section: {m}" for m in missing]
    good = 3 + (len(symbols) <= 1 and len(marked) >= 6) + (len(dates) <= 1) + (not grammar) + (not spelled) + email + (out["pages"] <= 2) + ("Work Experience / History" in detected) + ("Skills & Competencies" in detected)
    return out | scores | {"overall": overall, "grade": grade, "problems": problems, "suggested": [f'Suggested: "{s}"' for _, s in grammar], "n_good": good}


def lines_of_match(matched, missing, have, need, semantic, calibrated):
    """How many strengths, improvements and pieces of advice an explanation has."""
    strong = (len(matched) > 0) + (semantic >= 0.7) + (need > 0 and have >= need)
    weak = (semantic < 0.7) + (need > 0 and have < need) + (len(missing) > 0)
    advice = (need > 0 and have < 0.7 * need) + (len(missing) > 0) + (calibrated < 0.7)
    return max(1, strong), max(1, weak), max(1, advice)


def fields(text):
    """title, skills, education, experience of a profile."""
    from sievework.operators import text as X

    lines = [x.strip() for x in text.split("\n") if x.strip()]
    title = next((x for x in lines[:6] if any(w in x.lower() for w in X.TITLES)), lines[0] if lines else "Unknown")
    body = {}
    for n, (a, b) in X.FIELDS.items():
        m = re.search(rf"(?:{a})[\s:]+(.*?)(?:{b}|\Z)", text, re.I | re.S)
        body[n] = m[1] if m else ""
    full = {n: [x.strip() for x in v.split("\n") if x.strip()] for n, v in body.items()}
    skills = [x.strip() for x in re.split(r"[,•\n|;]+", body["skills"].strip()) if len(x.strip()) > 2][:6]
    return title, ", ".join(skills) or "Demonstrated domain skills in resume body", " | ".join(full["education"][:2])[:150] or "Not explicitly stated", " | ".join(full["experience"][:3])[:250] or "Experienced professional"
