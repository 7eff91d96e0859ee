"""Closed vocabularies and record schemas of the document graph."""

from __future__ import annotations

# fixed values
ENTITY_TYPES = ["Legal_Party", "Legal_Concept", "Obligation", "Right", "Jurisdiction", "Temporal_Entity", "Financial_Term", "Clause_Reference"]
RELATIONSHIP_TYPES = ["REFERENCES", "OBLIGATES", "GRANTS_RIGHT", "GOVERNS", "DEFINES", "MODIFIES", "DEPENDS_ON", "CONTRADICTS", "TEMPORALLY_PRECEDES", "FINANCIALLY_RELATES"]
STRUCTURAL_TYPES = ["CONTAINS", "MENTIONS", "HAS_PARTY"]
DOCUMENT_TYPES = ["contract", "agreement", "license", "amendment", "addendum", "policy", "statute", "regulation", "case_law", "other"]
PROCESSING_STATES = ["pending", "processing", "entity_extraction", "relationship_extraction", "graph_construction", "completed", "failed"]
NODE_LABELS = ["Entity", "LegalParty", "Obligation", "Right", "LegalConcept", "Jurisdiction", "TemporalEntity", "FinancialTerm", "Document", "Clause"]
REQUIRED_NODE_PROPERTIES = ["id", "text", "type", "confidence"]
MIN_ENTITY_CONFIDENCE, MIN_RELATIONSHIP_CONFIDENCE = 0.7, 0.65
OBLIGATES_SOURCES = ["LegalParty", "Clause"]
# fixed values: properties of each node label, of which id is unique and those after the bar have an index
NODE_PROPERTIES = {
    "Entity": "id text type confidence document_id chunk_id section position_start position_end extraction_method model timestamp | text type document_id",
    "LegalParty": "id name type role aliases confidence document_id | name document_id",
    "Obligation": "id text obligated_party obligation_type deadline confidence document_id clause_reference | document_id",
    "Right": "id text right_holder right_type conditions confidence document_id clause_reference | document_id",
    "LegalConcept": "id term definition domain synonyms confidence document_id | term",
    "Jurisdiction": "id name type level document_id | name",
    "TemporalEntity": "id text date_value duration temporal_type confidence document_id | document_id",
    "FinancialTerm": "id text amount currency payment_type frequency confidence document_id | document_id",
    "Document": "id title document_type date language file_path page_count status created_at updated_at | title document_type",
    "Clause": "id text clause_number clause_type section level document_id parent_clause_id | document_id clause_type",
}
# fixed values: labels that a relationship may lead from and to
EDGE_ENDS = {
    "REFERENCES": ("Entity Clause", "Entity Clause LegalConcept"),
    "OBLIGATES": ("LegalParty Clause", "LegalParty Obligation"),
    "GRANTS_RIGHT": ("LegalParty Clause", "LegalParty Right"),
    "GOVERNS": ("Jurisdiction", "Document Clause"),
    "DEFINES": ("Clause", "LegalConcept"),
    "MODIFIES": ("Clause", "Clause"),
    "DEPENDS_ON": ("Clause Obligation", "Clause Obligation"),
    "CONTRADICTS": ("Clause", "Clause"),
    "TEMPORALLY_PRECEDES": ("TemporalEntity Obligation", "TemporalEntity Obligation"),
    "FINANCIALLY_RELATES": ("LegalParty Obligation", "FinancialTerm"),
    "CONTAINS": ("Document Clause", "Clause"),
    "MENTIONS": ("Clause", "Entity LegalParty LegalConcept"),
    "HAS_PARTY": ("Document", "LegalParty"),
}
FULL_TEXT = {"Entity": ["text"], "Clause": ["text"], "LegalConcept": ["term", "definition"]}

NODES = "id string, text string, type string, label string, confidence double, document_id string"
EDGES = "id string, source_id string, target_id string, type string, confidence double, evidence string, document_id string"
ENTITIES = "id string, text string, type string, confidence double, context string, document_id string, chunk_id string, attributes map<string,string>, aliases array<string>, ordinal long"
DOCUMENTS = "id string, title string, content string, document_type string, file_path string, file_format string, metadata map<string,string>"
CHUNKS = "id string, document_id string, text string, start int, end int, chunk_index int, level int, parent_chunk_id string, section_title string, token_count int"


def label_of(entity_type: str) -> str:
    return entity_type.replace("_", "") if entity_type in ENTITY_TYPES else "Entity"


def properties_of(label: str) -> list[str]:
    """The declared properties of a node label, none if it is unknown."""
    return NODE_PROPERTIES.get(label, "").split("|")[0].split()


def indexed_of(label: str) -> list[str]:
    return NODE_PROPERTIES.get(label, "|").split("|")[1].split()


def is_node_label(label: str) -> bool:
    return label in NODE_PROPERTIES


def is_edge_type(kind: str) -> bool:
    return kind in EDGE_ENDS
