"""Spark types of the corpus records, as DDL, and fixed labels."""

TRIGGER = "struct<sentence_id: int, text: string, char_start: int, char_end: int>"
MENTION = "struct<sentence_id: int, text: string, char_start: int, char_end: int, role: string, mention_type: string, referent_semantics: string>"
CHAIN = f"struct<index: int, type: string, start_sentence: int, end_sentence: int, mentions: array<{MENTION}>, trigger: {TRIGGER}>"
DOCUMENT = (
    f"category_primary string, domain string, text string, sentences array<string>, coreference_chains array<{CHAIN}>, "
    "entities struct<persons: array<string>, orgs: array<string>, locations: array<string>>, _gen_id string"
)
PAIR_SCORE = "doc_key string, global_span1 array<int>, global_span2 array<int>, p_coref double"
E2E = "doc_key string, sentences array<array<string>>, clusters array<array<array<int>>>"
EVENT_DOC = (
    "doc_id string, document string, sentences array<struct<start: int, text: string>>, "
    "events array<struct<event_id: string, start: int, sent_idx: int, sent_start: int, trigger: string, subtype: string>>, "
    "clusters array<struct<hopper_id: string, events: array<string>>>"
)
GENERATION_LOG = (
    "gen_id string, timestamp_utc string, backend string, model string, model_version string, master_seed bigint, seed bigint, "
    "topic string, domain string, category_primary string, sampling map<string, double>, prompt_hash string, prompt string, "
    "raw_response_text string, validator struct<pass: boolean, reasons: array<string>>"
)

#: Column orders of the relational side tables.
DOC_MAP = [
    "doc_id", "split", "row_index", "global_doc_index", "domain", "category_primary", "source_model", "source_file", "group_id", "dup_cluster_id", "n_sentences", "n_chains", "n_mentions",
]
CHAIN_MAP = [
    "mode", "doc_id", "split", "conll_chain_id", "original_chain_index", "chain_type", "n_mentions_original", "n_mentions_exported", "dropped", "drop_reason",
]
MENTION_MAP = [
    "mode", "doc_id", "split", "mention_id", "conll_chain_id", "original_chain_index", "chain_type", "sentence_id", "mention_text", "role", "mention_type", "referent_semantics", "char_start", "char_end", "token_start", "token_end", "is_zero", "is_exported", "drop_reason",
]
TOKEN_MAP = [
    "mode", "doc_id", "split", "sentence_id", "token_id", "token_text", "char_start", "char_end", "is_zero_token", "zero_mention_id", "char_index_before",
]
TYPE_SLICE_MAP = [
    "mode", "doc_id", "split", "domain", "category_primary", "conll_chain_id", "chain_type", "mention_id", "mention_type", "referent_semantics", "is_zero", "sentence_id", "token_start", "token_end",
]
ISSUES = [
    "severity", "mode", "split", "doc_id", "row_index", "chain_index", "mention_id", "sentence_id", "error_type", "message", "first_sentence",
]

#: Labels.
ZERO, PERSON, DEMONSTRATIVE, DEFINITE = "零指代", "人称代词", "指示代词", "有定描述"
EVENT_CHAIN, EVENT_MENTION = "事件指代", "事件提及"
ZERO_SIGN = "Ø"
TYPE_EN = {ZERO: "Zero", PERSON: "Personal", DEMONSTRATIVE: "Demonstrative", DEFINITE: "Definite", EVENT_CHAIN: "Event", EVENT_MENTION: "Event"}
#: Priority of a chain's type among its members' types, and of a document's category among equal counts.
CHAIN_PRIORITY = [ZERO, PERSON, DEMONSTRATIVE, EVENT_MENTION, DEFINITE]
CATEGORY_PRIORITY = [ZERO, EVENT_CHAIN, PERSON, DEMONSTRATIVE, DEFINITE]
