"""The wording of briefs and drafts: texts with {places} that `fill` puts expressions into. Wording only; which text applies is decided in `drafts`."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

INSIGHT = "{about}The theme appears in {sources} on {domains}{scope}. {passages} of it could be checked word for word, and {independent} of the sources have nothing to sell."
INSIGHT_PROBLEM = " Said most concretely: “{problem}” (source #{problem_source})."
WHY_NOW = "The trend is **{status}**: {current} this period, {previous} in the one before"
WHY_NOW_NEWEST = " Latest dated source: “{newest_title}” ({newest_domain}, {newest_date})."
WHY_NOW_UNDATED = " None of the sources has a date, so nothing can be said about recency."
WHY_NOW_ALONE = " [Caution] Everything comes from one domain, which corroborates nothing."
WHY_COMPANY = "The company serves local businesses that live from answering demand. On average the sources on {name} are rated {relevance} of 10 for that market."
WHY_COMPANY_INDUSTRIES = " They touch {three_industries}."
WHY_COMPANY_OWN = " {own} among them are the company's own pages and show positioning, not evidence."
WHY_SPEAKER = "[Inference — from public facts only] The founder's company works on this problem{in_two}, which gives them standing to discuss it. Nothing here was said, seen or approved by them."
AUDIENCE = "People who own or run businesses{in_three}, and those who build and fund software for them."
VIEW = "[Inference — an argument, not a finding] {description} What was collected, from {domains} and {sources}, points to how work is organised more than to missing tools. Argue that case and leave the facts to the sources cited."
OBJECTION_VENDOR = ("A company in this market would say so.", "True. {promotional} of {sources} are marketing and marked as such; the case has to hold without them.")
OBJECTION_THIN = ("{domains} is little to build on.", "Yes. It is a hypothesis to be tested with more sources or with own data.")
OBJECTION_WIDE = ("Every vendor calls its own problem the largest.", "Here {domains} show the same, which is the least that a signal of the market needs.")
OBJECTION_NUMBERS = ("The figures come from those who gain by them.", "Agreed. Each is marked to be verified, and goes if no primary source has it.")
CALL = "Ask the reader to hold their own week against this ({name}) and to say what they find: a comparison of notes, no pitch."
CHECK_PAGES = ("Open each cited page and find the passage in it.", "Pages change, and a citation that leads nowhere costs trust.")
CHECK_DATES = ("Check the date of each cited source.", "What is said to be recent is easily wrong.")
CHECK_NUMBER = ("Find a primary source for “{value}” (now from source #{source}).", "How it was measured is not known.")
CHECK_QUOTE = ("Check who said “{quote}”.", "A quote under the wrong name harms people.")
CHECK_SOLD = ("Decide whether {promotional_label} may be cited.", "Marketing cited as evidence loses the argument.")
CHECK_VOICE = ("See that no sentence claims to be written or approved by a named person.", "No such approval exists.")
CONFIDENCE_WEAK = "Weak: one domain only. A lead for more research, not a position."
CONFIDENCE_THIN = "Thin: {passages} could be verified. Find more before publishing."
CONFIDENCE_FAIR = "Fair: {passages} from {domains} and {sources}. Enough to argue from; each figure still needs its primary source."

POINT_SAID = "— \"{body}\" — {domain} [{ids}]"
POINT_SUMMARY = "— {body}. [{ids}]"
POST = "{hook}\n\n{insight}\n\nIn the sources:\n{points}\n\n{view}{ask}\n\n[Draft for review by a person. Linked to evidence, not published.]\n{links}"
VIDEO = "# Short video — {title}\n\n**Hook (0-3s):** {hook}\n\n**Beats:**\n{beats}\n\n**Close:** {ask}\n\n**Spoken:** about {spoken} words (45-60 seconds).\n\n**Before filming:** no figure on screen without a primary source."
VIDEO_BEAT = "{number}. {said}\n   - On screen: “{passage}”\n   - Source: {ids} — {url}"
VIDEO_SAID = "Quote {domain}: \"{body}\""
NO_POINTS = "[NEEDS EVIDENCE] The theme has no point with evidence."
ESSAY = "# {title}\n\n**Thesis:** {view}\n\n## Sections\n1. **Why now** — {why_now}\n{sections}{objections_number}. **Objections**\n{objections}\n{close_number}. **Close** — {ask}\n\n## Evidence still missing\n{missing}"
ESSAY_SECTION = "{number}. **{said}**\n   - Evidence [{ids}]: “{passage}”\n   - {url}\n"
ESSAY_SAID = "From {domain}: \"{body}\""
ESSAY_OBJECTION = "   - *{objection}* → {response}"
ESSAY_THIN = "[NEEDS EVIDENCE] Under four points with evidence: not ready to be an essay."
ESSAY_FULL = "None: each section has a passage from a source."
TALK = "# Talking point — {title}\n\n**Position:**\n{insight}\n\n**Facts:**\n{facts}\n\n**Strongest objection:** {objection}\n**Answer:** {response}\n\n**A figure:** {figure}"
TALK_FACT = "- [{ids}] “{passage}”"
TALK_FIGURE = "“{passage}” (source #{source}); verify first."
TALK_NO_FIGURE = "none that was verified."
PODCAST = "# For a podcast — {title}\n\n**The host asks:** {question}?\n\n**One minute:**\n{view}\n\n**Example, from evidence only:**\n{facts}\n\n**Next question:** What would show that this is wrong, and how would you measure it?"
PODCAST_FACT = "- “{passage}” ({domain}, source #{source})"
STORY = "# Angle for a customer's story — {title}\n\n**A frame, not a story: it names no customer, and none may be made up.** It waits for a real customer who agrees, and for figures that were checked.\n\n**Frame:**\n1. Before: what came in, and what became of it.\n2. Where, when and how often it failed.\n3. What was changed in the work itself.\n4. What was measured afterwards, and how.\n5. What they would tell others.\n\n**Ask them:** how it was measured before; over what time; what else changed then; what got no better; whether name, figures and words may be used.\n\n**Needed:** consent in writing; a source outside sales for each figure; a lawyer's view where a result is promised.\n\n**Theme:** {insight}"
COMMENT = "# Comment — {title}\n\n**Draft, to be posted by a person (40-80 words):**\n\n{insight} What stays with me: {passage} Does that match what you see?\n\n**Rules:** no pitch, no link, no mere praise. Without a distinction, a counter-example or a question, leave it.\n\n**Evidence:** source #{source} — {url}"
NOTE = "# Internal note — {title}\n\n## Known\n{facts}\n\n## Changed\n{why_now}\n\n## Unknown\n{checks}\n\n## Next\n{ask}\n\n## Confidence\n{confidence}"
NOTE_FACT = "- [{ids}] {passage}"
NOTE_CHECK = "- {item} — {why}"

CONNECTION_INDUSTRY = "Within the served industries: {industries}."
CONNECTION_CATEGORY = "Within the company's own category."
CONNECTION_THEME = "By theme only; the market is another."
ANGLE_CLAIM = "Speak as an operator: what was measured, and over what time? Press on “{claim}”. A distinction or a question; no pitch, no link."
ANGLE_NONE = "Only with a specific point from operations; else leave it, for an empty reply costs standing."


def fill(text: str, places: Mapping[str, object], literal: Callable[[str], object], join: Callable[[list], object]) -> object:
    """The text with each {place} replaced: `literal` makes an expression of a piece of text, `join` one of all pieces."""
    pieces = re.split(r"\{(\w+)\}", text)
    return join([literal(p) if k % 2 == 0 else places[p] for k, p in enumerate(pieces) if k % 2 or p])
