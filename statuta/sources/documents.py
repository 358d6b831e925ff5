"""Schema documents of the records, in the usual keywords: type, required, properties,
additionalProperties, enum, pattern, minLength, maxLength, minimum, items, minItems, uniqueItems."""

from __future__ import annotations

from ..operators import validation as V


def text(nullable: bool = False, **more) -> dict:
    return {"type": ["string", "null"] if nullable else "string", **more}


def codes(*values, nullable: bool = False) -> dict:
    return text(nullable, enum=[*values, *([None] if nullable else [])])


def listed(items: dict, **more) -> dict:
    return {"type": "array", "items": items, **more}


def record(required: list[str], **properties: dict) -> dict:
    return {"type": "object", "additionalProperties": False, "required": required, "properties": properties}


# fixed values: vocabularies of the records
DAY = r"^\d{4}-\d{2}-\d{2}$"
DOMAINS = ("金融", "银行", "保险", "证券", "基金", "支付清算", "金融科技", "人工智能", "数据", "网络安全", "科技伦理", "消费者权益")
TOPICS = ("ai-governance", "model-risk", "algorithm-filing", "content-labeling", "deep-synthesis", "high-risk-ai", "human-oversight", "explainability", "bias-and-fairness", "data-security", "personal-information", "data-quality", "outsourcing", "open-source-management", "supply-chain", "cybersecurity", "prompt-injection", "business-continuity", "ethics-review", "consumer-protection", "disclosure", "computing-power", "talent-and-culture", "supervision-and-reporting")
COUNT = {"type": ["integer", "null"]}

VERSION = record(
    ["version", "published_on", "status", "url"],
    version={"type": "integer", "minimum": 1}, published_on=text(pattern=DAY), effective_from=text(True, pattern=DAY), effective_until=text(True, pattern=DAY), status=codes(*V.STATUSES), url=text(pattern=V.URL),
    archived_url=text(True), content_hash=text(True, pattern=V.HASH), change_note=text(True),
)
OBLIGATION = record(["clause", "summary"], clause=text(minLength=1), summary=text(minLength=4), obligation_type=codes(*V.OBLIGATIONS, nullable=True), tags=listed(text(), uniqueItems=True))
SOURCE = record(
    ["url", "site", "tier", "fetched_at"],
    url=text(pattern=V.URL), site=text(), tier=codes("primary", "secondary", "unverified"), fetched_at=text(pattern=V.STAMP), http_status=COUNT, content_hash=text(True, pattern=V.HASH), snapshot_path=text(True),
)
IDS = listed(text(pattern=V.ID), uniqueItems=True)
POLICY = record(
    ["id", "title", "issuer", "jurisdiction", "instrument_type", "bindingness", "ai_relevance", "domain", "status", "published_on", "source", "last_verified", "verified_by"],
    id=text(pattern=V.ID, minLength=6, maxLength=80), title=text(minLength=4, maxLength=300), title_en=text(True), issuer=text(minLength=2), issuer_code=text(pattern="^[a-z][a-z0-9_]*$"), doc_number=text(True),
    jurisdiction=codes("CN"), jurisdiction_detail=text(True), instrument_type=codes(*V.INSTRUMENTS), bindingness=codes(*V.BINDING), ai_relevance=codes(*V.RELEVANCE), domain=listed(codes(*DOMAINS), minItems=1, uniqueItems=True), topics=listed(codes(*TOPICS), uniqueItems=True),
    status=codes(*V.STATUSES), published_on=text(pattern=DAY), effective_from=text(True, pattern=DAY), effective_until=text(True, pattern=DAY), supersedes=IDS, superseded_by=text(True, pattern=V.ID), amends=IDS, amended_by=IDS,
    versions=listed(VERSION, minItems=1), source=SOURCE, last_verified=text(pattern=DAY), verified_by=codes("human", "automated"), verified_note=text(True), applicable_to=listed(text()), key_obligations=listed(OBLIGATION), language=codes("zh-CN"), tags=listed(text(), uniqueItems=True), notes=text(True),
)
PENALTY_SOURCE = record(["url", "site", "fetched_at"], url=text(pattern=V.URL), site=text(pattern=r"^[a-z0-9.-]+\.[a-z]{2,}$"), fetched_at=text(), tier=codes("primary", "secondary"), http_status=COUNT)
PENALTY = record(
    ["id", "decision_no", "party", "violation_type", "penalty_content", "authority", "jurisdiction", "source", "verified_by"],
    id=text(pattern=V.PENALTY_ID), decision_no=text(minLength=4), party=text(minLength=2), party_type=codes("institution", "individual", "unknown", nullable=True), violation_type=text(minLength=2), penalty_content=text(minLength=2), authority=text(minLength=2),
    legal_basis=text(True), decision_date=text(True), published_on=text(True), publicity_period=text(True), jurisdiction=text(), domain=listed(text(minLength=2)), related_policies=listed(text()), source=PENALTY_SOURCE, last_verified=text(True), verified_by=codes("human", "automated"), notes=text(True),
)
