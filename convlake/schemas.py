"""Schemas of the ledger tables and the fixed values that results depend on."""

CONVERSATIONS = "id long, source string, source_conversation_id string, title string, created_at_unix double, updated_at_unix double, is_archived boolean, is_starred boolean, tags string, source_metadata_json string"
MESSAGES = "id long, conversation_id long, source_message_id string, role string, content string, sequence_index int, created_at_unix double"
NOTES = "id long, timestamp timestamp, role string, content string, tags string, is_starred boolean, captured_via_id long"
IMPORT_RUNS = "id long, provider string, filename string, imported_at double, status string, conversations_imported int, messages_imported int, conversations_skipped int, conversations_failed int, error_message string"
ARTIFACTS = "artifact_id string, artifact_type string, source_conversation_ids array<string>, generation_timestamp string, llm_provider_used string, prompt_template_version string, content_text string, derived_from string, artifact_kind string, parent_packet_ids array<string>, content_json map<string, array<string>>, ambiguity_notes string"

# Providers and their display names.
PROVIDERS = {"chatgpt": "ChatGPT", "claude": "Claude", "claude_code": "Claude Code", "gemini": "Gemini", "grok": "Grok"}
NATIVE = "native"
IMPORTED_LANE, NATIVE_LANE = "imported_conversation", "native_memory"

# Words that are no signal, by use.
THREAD_STOPWORDS = tuple(
    "a an the and or but in on at to for of with by from is it that this was are be has had have will can do does did not "
    "so if my me we our you your its i about up out just how what when where which who some all no new more very into over "
    "after also than then been could would should there their them these those other one two first chat conversation untitled".split()
)
TOPIC_STOPWORDS = tuple(
    "a an the and or but in on at to for of is it this that with from by be are was were been have has had do does did will "
    "would could should can may might shall not no yes so if then than too also just about up out how what when where who "
    "which why all each every some any many more most other another such only own same into over after before between through "
    "during without again further once here there these those me my he she we they its his her our their you your i".split()
)
LINEAGE_STOPWORDS = (*TOPIC_STOPWORDS, *"new chat help use make using used get".split())
QUESTION_STOPWORDS = tuple("the and for with what when where which about have from that this your into note notes did".split())
TAG_STOPWORDS = tuple("the a an my your how do can what why when where is are i you we us to for of and or but in on at with this that these those it".split())
CONTINUATION_PHRASES = ("continuing from", "as we discussed", "following up on", "picking up where", "back to our", "to continue", "last time we", "building on", "as a follow-up", "resuming")
ARTIFACT_TYPES = ("summary", "decisions", "open_loops", "entity_map", "bridge")

# Budgets in characters.
DISTILL_BUDGET, PACKET_BUDGET, BRIDGE_BUDGET = 180_000, 80_000, 12_000
# Life cycle of a capture (state, action, next state).
CAPTURE_EDGES = (
    ("pending", "triage", "triaged"),
    ("pending", "promote", "promoted"),
    ("pending", "reject", "rejected"),
    ("pending", "quarantine", "quarantined"),
    ("triaged", "promote", "promoted"),
    ("triaged", "reject", "rejected"),
    ("triaged", "quarantine", "quarantined"),
    ("quarantined", "triage", "triaged"),
    ("quarantined", "reject", "rejected"),
)
