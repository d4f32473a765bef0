"""Planning on the driver: one query in, small lists out.

A query is normalised, its entities are found, goals and query variants follow from them, and
requests to search services are planned. The column forms of the same expressions serve tables of
queries.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ----------------------------------------------------------------------------

PATTERNS = {
    "DOI": r"\b10\.\d{4,9}/[-._;()/:A-Za-z0-9]+\b",
    "PMID": r"(?i)\b(?:PMID:?\s*|PMC)\d+\b",
    "STANDARD": r"(?i)\b(?:ГОСТ|ISO|RFC|IEEE)\s*[\d.-]+(?::\d+)?\b",
    "SOFTWARE_API": r"\b[A-Z][a-zA-Z0-9_]+::[A-Za-z0-9_]+\b|\b[A-Z]{2,}_[A-Z0-9_]{3,}\b",
    "VERSION": r"\bv?\d+\.\d+(?:\.\d+)?\b",
}
TERMS = {
    "DISEASE": ("diabetes", "диабет", "oncology", "онкология", "hypertension", "гипертония", "carcinoma", "melanoma"),
    "CHEMICAL": ("aspirin", "аспирин", "insulin", "инсулин", "metformin", "метформин", "crispr"),
    "PRODUCT": ("qdrant", "fastembed", "servo", "webrender", "chromium", "sqlite", "crawlee", "playwright"),
    "SOFTWARE_API": ("simhash", "minhash", "nxopen"),
}
MEDICAL_SERVICES = ("pubmed", "europe_pmc", "semantic_scholar", "openalex")
ACADEMIC_SERVICES = ("semantic_scholar", "openalex", "crossref", "arxiv", "regional")
OPEN_SERVICES = (("general", 20), ("web_search", 15), ("wikipedia", 5))
COMPARED = (" vs ", " versus ", "сравнение", "против")
SIDES = r"(?i)\b(?:vs|versus|против|и)\b"
#: Words that tell what a question is about and what evidence it needs.
MEDICAL_CUES = ("клиническ", "лечени", "medicin", "drug", "trial", "efficacy", "therapy")
SOFTWARE_CUES = ("api", "function", "library", "sdk", "qdrant", "rust", "python")
DISPUTE_CUES = ("controversy", "dispute", "противореч", "побочные эффекты", "side effect", "risk", "criticism")
CLINICAL_CUES = ("cancer", "tumor", "dna", "rna", "crispr", "clinical", "disease", "drug", "trial", "therapy", "biopsy", "cell", "protein", "gene", "mutation", "oncology", "patient", "syndrome", "inhibitor", "antibody")
MEDICAL_EVIDENCE = ("GUIDELINE", "REGULATOR", "SYSTEMATIC_REVIEW", "META_ANALYSIS", "PRIMARY_RESEARCH")
SOFTWARE_EVIDENCE = ("OFFICIAL_DOC", "SOURCE_CODE", "STANDARD", "ISSUE_TRACKER")
PLAIN_EVIDENCE = ("OFFICIAL_DOC", "PRIMARY_RESEARCH", "WIKI")
STUDIES = "(systematic review OR meta-analysis OR clinical trial OR randomized controlled)"
#: Terms and their English counterparts, replaced one after the other.
TRANSLATIONS = (
    ("жидкостная биопсия", "liquid biopsy ctDNA circulating tumor DNA"), ("колоректальный рак", "colorectal cancer"), ("онкологи", "oncology cancer neoplasms"), ("иммунотерапи", "immunotherapy checkpoint inhibitors PD-1 CTLA-4"),
    ("биомаркер", "biomarker diagnostic prognostic clinical validation"), ("мутаци", "gene mutation variant pathogenicity CRISPR Cas9"), ("фармако", "pharmacokinetics pharmacodynamics drug bioavailability"),
    ("сердечн", "cardiovascular atherosclerosis myocardial infarction"), ("нейродеген", "neurodegenerative Alzheimer Parkinson neuroprotection"), ("микробиом", "microbiome gut microbiota 16S rRNA sequencing"),
    ("вакцин", "vaccine mRNA adjuvant immunogenicity efficacy"), ("квантов", "quantum computing algorithm entanglement"), ("лазерн", "laser cutting assist gas nozzle parameters"), ("резани", "machining parameters cutting speed feed rate"),
    ("титан", "titanium alloy Ti6Al4V microstructure"), ("печать", "3D printing additive manufacturing SLM"), ("аддитивн", "additive manufacturing selective laser melting"), ("твердотельн", "solid state battery solid electrolyte conductivity"),
    ("аккумулятор", "lithium ion battery cathode anode degradation"), ("графен", "graphene 2D materials synthesis characterization"), ("перовскит", "perovskite solar cells photovoltaic efficiency stability"),
    ("сверхпровод", "superconductivity high temperature superconductor critical current"), ("спектроскоп", "spectroscopy FTIR Raman XRD characterization"), ("полупроводник", "semiconductor bandgap heterojunction transistor"),
    ("композит", "composite materials carbon fiber reinforced matrix"), ("микроконтроллер", "microcontroller embedded systems firmware ARM RISC-V"), ("нейросеть", "neural networks deep learning RAG LLM"),
    ("трансформер", "transformer attention mechanism LLM"), ("векторн", "vector database embeddings similarity search HNSW"), ("обучение с подкреплением", "reinforcement learning policy gradient PPO RLHF"),
    ("компьютерное зрение", "computer vision object detection segmentation"), ("генеративн", "generative AI diffusion models LLM"), ("распределенн", "distributed consensus Raft Paxos replication"),
    ("безопасност", "cybersecurity vulnerability exploit mitigation"), ("первичное исследование", "randomized clinical trial systematic review meta-analysis"), ("научная статья", "journal article peer reviewed DOI"),
    ("гост", "standard specification technical requirements"), ("патент", "patent claims prior art intellectual property"), ("сравнение", "comparative analysis benchmark performance evaluation"),
    ("мета-анализ", "meta-analysis systematic review PRISMA forest plot"),
)


@dataclass(frozen=True)
class Entity:
    name: str
    kind: str


@dataclass
class Query:
    text: str
    quoted: list[str] = field(default_factory=list)
    identifiers: list[str] = field(default_factory=list)
    languages: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Goal:
    goal_id: str
    question: str
    importance: float
    required_types: tuple[str, ...] = ()
    depends: tuple[str, ...] = ()


@dataclass(frozen=True)
class Variant:
    query: str
    goal_id: str
    language: str = "en"
    priority: float = 0.5
    kind: str = "SEMANTIC"
    service: str | None = None


def normalise(text: str) -> Query:
    """Compatibility forms and white space squeezed; quoted phrases, identifiers and scripts told apart."""
    plain = " ".join(unicodedata.normalize("NFKC", text or "").split())
    quoted = [q.strip() for q in re.findall(r"[\"«“]([^\"»”]+)[\"»”]", plain) if q.strip()]
    found = sorted({m for p in PATTERNS.values() for m in re.findall(p, plain)})
    languages = [name for name, p in (("en", "[a-zA-Z]"), ("ru", "[Ѐ-ӿ]")) if re.search(p, plain)]
    return Query(plain, quoted, found, languages or ["en"])


def entities(text: str) -> list[Entity]:
    """Entities by pattern, then by term, each name once without regard to case."""
    out: dict[str, Entity] = {}
    for kind, pattern in PATTERNS.items():
        for name in re.findall(pattern, text or ""):
            out.setdefault(name.lower(), Entity(name, kind))
    for kind, terms in TERMS.items():
        for name in terms:
            if name in (text or "").lower():
                out.setdefault(name, Entity(name, kind))
    return list(out.values())


def entity_column(text: Column) -> Column:
    """The same entities of a column, as an array of structs (kind, name), each name once a kind."""
    def named(kind: str, pattern: str) -> Column:
        return F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))

    parts = [named(kind, p) for kind, p in PATTERNS.items()]
    known = [(kind, name) for kind, terms in TERMS.items() for name in terms]
    listed = F.filter(F.array(*[F.when(F.contains(F.lower(text), F.lit(n)), F.struct(F.lit(k).alias("kind"), F.lit(n).alias("name"))) for k, n in known]), lambda x: x.isNotNull())
    return F.coalesce(F.concat(*parts, listed), F.array().cast("array<struct<kind:string,name:string>>"))


def _any(text: str, cues: tuple[str, ...]) -> bool:
    return any(c in text for c in cues)


def goals(text: str, task: str = "general_research") -> list[Goal]:
    """The main question; for a comparison its first two sides; for a dispute the case against; each standard named.

    What evidence the first ones need follows from the subject: medicine before software before the rest.
    All but the main question depend on it.
    """
    q = normalise(text).text
    low, named = q.lower(), entities(q)
    kinds = {e.kind for e in named}
    if task == "medical" or kinds & {"DISEASE", "CHEMICAL"} or _any(low, MEDICAL_CUES):
        needs = MEDICAL_EVIDENCE
    elif task in ("technical", "code") or kinds & {"SOFTWARE_API", "PRODUCT"} or _any(low, SOFTWARE_CUES):
        needs = SOFTWARE_EVIDENCE
    else:
        needs = PLAIN_EVIDENCE
    found = [(f"Answer primary research question: {q}", 1.0, needs)]
    sides = re.split(SIDES, q) if _any(low, COMPARED) else []
    if len(sides) > 1:
        found += [(f"Investigate characteristics and properties of {s.strip()}", 0.8, needs) for s in sides[:2]]
    if _any(low, DISPUTE_CUES):
        found.append((f"Investigate criticisms, adverse effects, and counter-evidence for: {q}", 0.9, ("PRIMARY_RESEARCH", "SYSTEMATIC_REVIEW", "ISSUE_TRACKER", "FORUM")))
    found += [(f"Retrieve official normative standard specifications for {e.name}", 0.9, ("STANDARD", "OFFICIAL_DOC")) for e in named if e.kind == "STANDARD"]
    return [Goal(f"g{k}", question, weight, types, ("g1",) if k > 1 else ()) for k, (question, weight, types) in enumerate(found, 1)]


def variants(text: str, targets: list[Goal], per_goal: int = 4, most: int = 16) -> list[Variant]:
    """Query variants of each goal, at most ``per_goal``: as asked, its first entities, its terms in English, with kinds of
    studies, for regional services. Each (query, language) once, at most ``most`` in all."""
    q = normalise(text).text
    plain = q.isascii()
    language = lambda part: "en" if part.isascii() else "ru"
    names = " ".join(e.name for e in entities(q)[:3])
    english = q.lower()
    for term, other in () if plain else TRANSLATIONS:
        english = english.replace(term, other)
    seen, out = set(), []
    for goal in targets:
        asked = [Variant(q, goal.goal_id, language(q[:10]), 1.0)]
        if names:
            asked.append(Variant(names, goal.goal_id, "en", 0.9, "ENTITY"))
        if english != q.lower():
            asked.append(Variant(english, goal.goal_id, "en", 0.92, "DOMAIN_SPECIFIC"))
        if {"GUIDELINE", "PRIMARY_RESEARCH", "SYSTEMATIC_REVIEW"} & set(goal.required_types):
            asked.append(Variant(f"{q} {STUDIES}", goal.goal_id, "en", 0.88, "PRIMARY_SOURCE", "semantic_scholar"))
        asked.append(Variant(q, goal.goal_id, language(q), 0.80, "DOMAIN_SPECIFIC", "regional"))
        for v in asked[:per_goal]:
            key = (v.query.lower().strip(), v.language)
            if key not in seen and len(out) < most:
                seen.add(key)
                out.append(v)
    return out


def followups(terms: list[str], query: str, goal_id: str = "goal_followup") -> list[Variant]:
    """The query with each of the first three terms found on the way that have more than three letters."""
    tidy = [t.strip() for t in terms[:3]]
    return [Variant(f"{query} {t}", goal_id, "en" if t.isascii() else "ru", 0.85, "DOMAIN_SPECIFIC") for t in tidy if len(t) > 3]


def plan_requests(text: str, goal: Goal, asked: list[Variant], pool: int = 25, most: int = 8, task: str = "general_research") -> list[tuple[str, str, int, str]]:
    """(service, query, results, language) of a goal, at most ``most``, variant by variant.

    A variant's own service comes first, even again; then medical services where the question is
    medical, academic ones, code where it is asked for, the open web; of these each service once.
    """
    size = min(max(5, pool // 2), 50)
    medical = "GUIDELINE" in goal.required_types or task in ("medical", "bio", "healthcare") or _any(normalise(text).text.lower(), CLINICAL_CUES)
    code = "SOURCE_CODE" in goal.required_types or task in ("technical", "code")
    out: list[tuple[str, str, int, str]] = []
    for v in (v for v in asked if v.goal_id == goal.goal_id):
        if len(out) >= most:
            break
        if v.service:
            out.append((v.service, v.query, size, v.language))
        wanted = [(s, size, "en") for s in MEDICAL_SERVICES if medical] + [(s, size, v.language) for s in ACADEMIC_SERVICES]
        wanted += [("github", min(size, 10), "en")] if code else []
        wanted += [(s, min(size, n), v.language) for s, n in OPEN_SERVICES]
        for service, n, language in wanted:
            if all(service != r[0] for r in out):
                out.append((service, v.query, n, language))
    return out[:most]


def translated(query: Column, pairs: tuple[tuple[str, str], ...] | list[tuple[str, str]] = TRANSLATIONS) -> Column:
    """The query with each term replaced by its counterpart, one after the other."""
    for a, b in pairs:
        query = F.replace(query, F.lit(a), F.lit(b))
    return query
