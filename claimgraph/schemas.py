"""Schemas of the data model, as DDL."""

REFS = "array<struct<pmid:string,source_sentence:string,canonical_id:string,source:string,source_id:string,statement:string>>"
CONTEXT = "struct<cell_types:array<string>,disease:array<string>,drugs:array<string>,tissues:array<string>>"

PUBLICATIONS = (
    "pmid string, title string, abstract string, authors array<string>, journal string, year int, doi string, "
    "mesh_terms array<string>, publication_types array<string>, species string, tissue string, cell_type string, model string"
)
CLAIMS = (
    "source string, source_type string, relation string, target string, target_type string, polarity string, pmid string, "
    "pmids array<string>, year int, species string, confidence double, extraction_method string, source_sentence string, "
    f"claim_id string, provenance_type string, evidence_state string, session string, source_refs {REFS}, context {CONTEXT}"
)
NODES = "id string, type string, pmid_count int, pmids array<string>, edge_count int, provenance_type string, provenance_types array<string>"
TARGETS = "run_id string, disease string, genes array<string>, drugs array<string>, tissues array<string>, cell_types array<string>"
EVENTS = "run_id string, seq long, event_type string, step_id string, agent string, tokens double, created_at timestamp"
