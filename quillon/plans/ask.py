"""Answers to questions about a profile, by key words. No job runs: answers come from the collected profile."""

from __future__ import annotations

from quillon.functions.numbers import fixed
from quillon.plans.analysis import Profile

#: Key words of each intent, in order of precedence.
INTENTS = (
    ("summary", ("summary", "summarize")),
    ("columns", ("column", "feature", "what are")),
    ("correlation", ("correlation",)),
    ("distribution", ("distribution", "spread", "range")),
    ("category", ("category", "mode", "frequent")),
    ("maximum", ("highest", "maximum", "max")),
    ("average", ("average", "mean")),
    ("insights", ("insight", "pattern", "anomal")),
)


def intent(question: str) -> str:
    low = question.lower()
    return next((name for name, words in INTENTS if any(w in low for w in words)), "help")


def _named(question: str, rows: list[dict]) -> dict | None:
    """The first column, in file order, that the question names."""
    return next((r for r in rows if r["column"].lower() in question.lower()), None)


def ask(profile: Profile, question: str) -> str | None:
    """The answer; none to a blank question."""
    if not question.strip():
        return None
    return _ANSWERS[intent(question)](profile, question)


def _summary(p: Profile, q: str) -> str:
    text = f"**{p.rows} records** in **{len(p.columns)} columns**: {len(p.numeric)} numeric, {len(p.categorical)} categorical."
    if p.correlations:
        best = max(p.correlations, key=lambda r: abs(r["correlation"]))
        text += f" Strongest correlation: {best['col1']} and {best['col2']} ({fixed(best['correlation'], 2)})."
    return text


def _columns(p: Profile, q: str) -> str:
    return f"**Numeric:** {', '.join(p.numeric_names)}\n\n**Categorical:** {', '.join(p.categorical_names)}"


def _correlation(p: Profile, q: str) -> str:
    strong = [r for r in p.correlations if abs(r["correlation"]) > 0.6][:3]
    if not strong:
        return "No correlation is above 0.6."
    return "Correlations above 0.6:\n" + "\n".join(f"- **{r['col1']}** and **{r['col2']}**: {fixed(r['correlation'], 2)}" for r in strong)


def _distribution(p: Profile, q: str) -> str:
    r = _named(q, p.numeric)
    if r is None:
        return "Name a numeric column to see its distribution."
    low, high, q1, q3 = (float(fixed(r[k], 2)) for k in ("min", "max", "q1", "q3"))
    return f"**{r['column']}** lies between **{fixed(low, 2)}** and **{fixed(high, 2)}** (range {fixed(high - low, 2)}); its middle half between {fixed(q1, 2)} and {fixed(q3, 2)} (IQR **{fixed(q3 - q1, 2)}**)."


def _category(p: Profile, q: str) -> str:
    r = _named(q, p.categorical)
    if r is None:
        return "Name a categorical column to see its most frequent categories."
    top = p.frequencies[r["column"]][:3]
    text = f"**{r['mode']}** is the most frequent category of **{r['column']}**"
    if top:
        text += f" ({fixed(top[0]['percentage'], 1)}%)"
        if top[1:]:
            text += ", then " + ", ".join(f"{t['name']} ({fixed(t['percentage'], 1)}%)" for t in top[1:])
    return text + "."


def _maximum(p: Profile, q: str) -> str:
    r = _named(q, p.numeric)
    return f"The maximum of **{r['column']}** is **{fixed(r['max'], 2)}**." if r else "Name a numeric column."


def _average(p: Profile, q: str) -> str:
    r = _named(q, p.numeric)
    return f"The mean of **{r['column']}** is **{fixed(r['mean'], 2)}**, its median {fixed(r['median'], 2)}." if r else "Name a numeric column."


def _insights(p: Profile, q: str) -> str:
    found = [i for i in p.insights if i["type"] != "success"]
    return "\n\n".join(f"**{i['agent']}**: {i['text']}" for i in found) if found else "Nothing stands out."


def _help(p: Profile, q: str) -> str:
    return "Ask for a summary, the columns, correlations, the distribution, maximum or average of a numeric column, the most frequent category of another, or insights."


_ANSWERS = {"summary": _summary, "columns": _columns, "correlation": _correlation, "distribution": _distribution, "category": _category, "maximum": _maximum, "average": _average, "insights": _insights, "help": _help}
