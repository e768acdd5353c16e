"""Default vocabularies, as plain data. They must equal the published lists for equal results.

Operators take all of them as arguments.
"""

KNOWN_NODE_TYPES = ["Cell", "Cytokine", "Molecule", "Tissue", "Clinical_phenotype", "Pathway", "Gene", "Drug", "Cell_type"]

ACTIVATE = ["activates", "induces", "recruits", "promotes", "maintains", "differentiates_into"]
SUPPRESS = ["suppresses", "inhibits", "blocks", "reduces"]

RELATION_CUES = {
    "induces": r"induc|driv|promot|lead[s]? to|result[s]? in|produc|secre|express|upregulat",
    "activates": r"activat|stimulat|trigger|contribut|depend|requir",
    "recruits": r"recruit|expand|migrat",
    "suppresses": r"suppress|inhibit|block|reduc|decreas|downregulat",
    "differentiates_into": r"differentiat",
    "maintains": r"maintain|sustain",
}
CONTEXT_MARKERS = r"tissue|cell|epithel|airway|lung|bronch|mucosa|resident|organ"

EVIDENCE_LEVELS = {
    "Meta-Analysis": ("systematic_review", 0.95),
    "Systematic Review": ("systematic_review", 0.90),
    "Clinical Trial": ("clinical_trial", 0.85),
    "Randomized Controlled Trial": ("clinical_trial", 0.85),
    "Multicenter Study": ("human_cohort", 0.80),
    "Observational Study": ("human_cohort", 0.70),
    "Comparative Study": ("human_cohort", 0.65),
    "Cohort Studies": ("human_cohort", 0.70),
    "Case-Control Studies": ("human_cohort", 0.60),
    "Review": ("review", 0.55),
    "Journal Article": ("primary_research", 0.50),
}

STUDY_DESIGNS = [
    ("randomized_controlled_trial", "randomized controlled trial"),
    ("clinical_trial", "clinical trial"),
    ("cohort", "cohort"),
    ("case_control", "case-control"),
    ("single_cell", "single-cell"),
    ("in_vitro", "in vitro"),
    ("review", "review"),
]

PATHWAYS = {
    "AMPK": r"\bAMPK\b|AMP-activated protein kinase|Ampk",
    "mTORC1": r"\bmTORC1\b|mechanistic target of rapamycin complex 1",
    "mTOR": r"\bmTOR\b|mechanistic target of rapamycin",
    "PI3K/AKT": r"\bPI3K\b|\bAKT\b|phosphoinositide 3-kinase",
    "MAPK": r"\bMAPK\b|mitogen-activated protein kinase",
    "NF-kB": r"\bNF-?κ?B\b|nuclear factor kappa B",
}
DIRECT_CUES = r"bind|neutraliz|monoclonal antibody|blocking antibody|\binhibitor\b|\binhibits?\b|\btarget(?:s|ed|ing)?\b"
INDIRECT_CUES = r"pathway|signaling|signalling|downstream|mediates|modulat|inhibit|activat|phosphorylat|ampk|mtor"
CAUSAL_CUES = r"(?<!-)activat|driv|promot|regulat|downstream|depend|requir|mediates?|suppress|downregulat|reduc"
SUPPRESS_CUES = r"inhibit|suppress|block|downregulat|reduc"
POSITIVE_CUES = r"activat|driv|lead|promot"

#: Other names of genes, by lower-case name.
GENE_ALIASES = {"braf": ["B-RAF", "BRAF V600E", "BRAF mutations"]}

#: Role-scoped aliases: (node type, compact label) -> label.
NODE_LABELS = {
    ("Cytokine", "il33"): "IL-33",
    ("Cytokine", "il4"): "IL-4",
    ("Cytokine", "il5"): "IL-5",
    ("Cytokine", "il13"): "IL-13",
    ("Cytokine", "il25"): "IL-25",
    ("Drug", "itepekimab"): "itepekimab",
    ("Tissue", "lung"): "Lung",
    ("Tissue", "airwayepithelium"): "Airway epithelium",
    ("Cell_type", "airwayepithelialcell"): "airway epithelial cell",
    ("Cell", "ilc2"): "ILC2",
}

#: A pattern is (verbs, relation); what stands before and after the verb are the ends.
CAUSAL_VERBS = [
    ("induces?|induced|inducing|induction of", "induces"),
    ("activates?|activated|activating|activation of", "activates"),
    ("stimulates?|stimulated|stimulating", "activates"),
    ("promotes?|promoted|promoting|promotes the development of", "activates"),
    ("drives?|drove|driving", "activates"),
    ("recruits?|recruited|recruitment of", "recruits"),
    ("inhibits?|inhibited|inhibiting|inhibition of", "suppresses"),
    ("suppresses?|suppressed|suppressing|suppression of", "suppresses"),
    ("reduces?|reduced|reducing|reduction of|decreases?|decreased", "suppresses"),
    ("blocks?|blocked|blocking", "suppresses"),
    ("differentiates?|differentiated|differentiation into", "differentiates_into"),
    ("produces?|produced|production of|secretes?|secreted|secretion of|releases?|released|release of", "induces"),
    ("maintains?|maintained|maintenance of", "maintains"),
    ("contributes? to|contributed to|contribute to", "activates"),
    ("leads? to|led to|leading to|results? in|resulted in", "induces"),
    ("dependent on|depends on|requires?|required for", "activates"),
    ("expresses?|expressed|expression of|upregulates?|upregulated|upregulation of", "induces"),
]

#: Spellings of node names, tried in this order.
NODE_ALIASES = [
    ("il-4", "IL-4"), ("il4", "IL-4"), ("il 4", "IL-4"), ("il-5", "IL-5"), ("il5", "IL-5"), ("il-13", "IL-13"), ("il13", "IL-13"),
    ("il-33", "IL-33"), ("il33", "IL-33"), ("il-25", "IL-25"), ("il25", "IL-25"), ("tslp", "TSLP"), ("thymic stromal lymphopoietin", "TSLP"),
    ("ilc2", "ILC2"), ("ilc2s", "ILC2"), ("group 2 innate lymphoid", "ILC2"),
    ("th2", "Th2 cell"), ("th2 cell", "Th2 cell"), ("t helper 2", "Th2 cell"), ("th2 cells", "Th2 cell"), ("cd4+ th2", "Th2 cell"),
    ("eosinophil", "Eosinophil"), ("eosinophils", "Eosinophil"), ("neutrophil", "Neutrophil"), ("neutrophils", "Neutrophil"),
    ("mast cell", "Mast cell"), ("mast cells", "Mast cell"), ("basophil", "Basophil"), ("basophils", "Basophil"),
    ("dendritic cell", "Dendritic cell"), ("dendritic cells", "Dendritic cell"), ("cdc1", "cDC1"), ("conventional dendritic cell", "Dendritic cell"),
    ("airway epithelium", "Airway epithelium"), ("airway epithelial", "Airway epithelium"), ("epithelial cell", "Airway epithelium"),
    ("bronchial epithelium", "Airway epithelium"), ("goblet cell", "Goblet cell"), ("goblet cells", "Goblet cell"),
    ("smooth muscle", "Airway smooth muscle"), ("fibroblast", "Fibroblast"), ("fibroblasts", "Fibroblast"),
    ("ige", "IgE"), ("immunoglobulin e", "IgE"), ("il-4r", "IL-4R"), ("il4r", "IL-4R"), ("il-4 receptor", "IL-4R"), ("il-5r", "IL-5R"), ("il5r", "IL-5R"),
    ("il-13r", "IL-13R"), ("st2", "ST2"), ("il-33 receptor", "ST2"), ("il1rl1", "ST2"), ("gata3", "GATA3"), ("stat6", "STAT6"), ("batf3", "Batf3"),
    ("airway inflammation", "Airway inflammation"), ("airway hyperresponsiveness", "Airway hyperresponsiveness"), ("ahr", "Airway hyperresponsiveness"),
    ("airway remodeling", "Airway remodeling"), ("mucus production", "Mucus hypersecretion"), ("mucus hypersecretion", "Mucus hypersecretion"),
    ("type 2 inflammation", "Type 2 inflammation"), ("type 2 immune response", "Type 2 inflammation"), ("type 2 immunity", "Type 2 inflammation"),
    ("t2 inflammation", "Type 2 inflammation"), ("allergen", "Allergen"), ("allergens", "Allergen"), ("house dust mite", "House dust mite"),
    ("hdm", "House dust mite"), ("bone marrow", "Bone marrow"), ("lung", "Lung"), ("airway", "Airway"),
    ("tissue-resident memory", "Tissue-resident memory T cell"), ("trm", "Tissue-resident memory T cell"), ("resident memory t cell", "Tissue-resident memory T cell"),
    ("trained immunity", "Trained immunity"), ("dupilumab", "Dupilumab"), ("mepolizumab", "Mepolizumab"), ("benralizumab", "Benralizumab"),
    ("tezepelumab", "Tezepelumab"), ("omalizumab", "Omalizumab"),
]

#: Node types by name.
NODE_LEXICON = {
    "Cell": ["ILC2", "Th2 cell", "Eosinophil", "Neutrophil", "Mast cell", "Basophil", "Dendritic cell", "cDC1", "Goblet cell", "Fibroblast", "Tissue-resident memory T cell", "Innate immune cell"],
    "Cytokine": ["IL-4", "IL-5", "IL-13", "IL-33", "IL-25", "TSLP"],
    "Molecule": ["IgE", "IL-4R", "IL-5R", "IL-13R", "ST2", "GATA3", "STAT6", "Batf3", "Dupilumab", "Mepolizumab", "Benralizumab", "Tezepelumab", "Omalizumab"],
    "Tissue": ["Airway epithelium", "Lung", "Airway", "Bone marrow"],
    "Clinical_phenotype": ["Airway inflammation", "Airway hyperresponsiveness", "Airway remodeling", "Mucus hypersecretion", "Type 2 inflammation"],
}

#: Node names that are never artifacts, besides those of the aliases.
CANONICAL_NODES = [
    "IL-4", "IL-5", "IL-13", "IL-33", "IL-25", "TSLP", "IL-12", "ILC2", "ILC3", "Th2 cell", "Th17 cell", "Eosinophil", "Neutrophil", "Mast cell", "Basophil",
    "Dendritic cell", "cDC1", "Goblet cell", "Fibroblast", "Tissue-resident memory T cell", "Innate immune cell", "Airway epithelium", "Intestinal epithelium",
    "Lung", "Airway", "Bone marrow", "IgE", "GATA3", "STAT6", "Batf3", "ST2", "IL-4R", "IL-5R", "IL-13R", "Allergen", "House dust mite", "Type 2 inflammation",
    "Airway inflammation", "Airway hyperresponsiveness", "Airway remodeling", "Mucus hypersecretion", "Dupilumab", "Mepolizumab", "Benralizumab", "Tezepelumab",
    "Omalizumab", "Trained immunity", "Airway smooth muscle", "NOD2", "TNF", "IL-23", "IL-22", "Epithelial barrier", "Intestinal inflammation",
]

#: Rules for artifact names: names that are stop words; patterns; for a fragment in title case, words that speak for a name.
STOP_NODES = ["And", "Or", "The", "In", "To", "Of", "For", "With", "By"]
ARTIFACT_PATTERNS = [
    r"^(They|We|This|These|While|However|Mainly|Only|Our|Such|Experimental|Sustained|Type-2|Type 2)\b",
    r"transcription factor|transcriptional program|encoding gene|chemokine receptor-encoding",
    r"^(A|An|The)\s+[A-Z]",
    r"inflammation and tissue damage|strongly reduced|have strongly",
    r"^type-?\s*2\s+(cytokines|inflammation is|endotype)",
    r"^(mscs|mice|patients|results|conclusion|background|methods)\b",
]
NAME_WORDS = ["il", "cd", "th", "tslp", "ige", "hdm", "trm", "ilc", "dc", "ahr"]
NAME_PATTERN = r"\b(cell|cells|cytokine|receptor|antibody|mab|epithelium|inflammation|asthma|marrow|allergen)\b"

#: Words that mark a label as a piece of a sentence.
NOISE_WORDS = [
    "and", "or", "but", "by", "of", "in", "on", "at", "to", "is", "was", "were", "are", "be", "been", "the", "a", "an", "then", "also", "through", "thereby",
    "therefore", "thus", "hence", "which", "that", "this", "these", "those", "can", "could", "may", "might", "will", "would", "it", "its", "their",
    "they", "suggesting", "showing", "revealing", "indicating", "demonstrating", "indicates", "shows", "reveals", "suggests", "significantly", "markedly",
    "ultimately", "primarily", "whereas", "while", "after", "before", "both", "from", "with", "as", "not", "no", "so", "such", "than", "completely",
    "demonstrated", "revealed", "showed", "expressed", "induced", "reduced", "increased", "decreased", "enhanced", "promoted", "inhibited", "activated",
    "downregulated", "upregulated", "regulates", "mediates", "triggers", "causes", "leads", "results", "led", "result",
]

#: Base types over which a requested type may be laid.
COMPATIBLE_TYPES = {
    "Disease": ["Disease", "Clinical_phenotype"],
    "Gene": ["Gene"],
    "Drug": ["Drug", "Molecule"],
    "Tissue": ["Tissue"],
    "Cell_type": ["Cell", "Cell_type"],
}

#: Rank of node types in the hub score; others have 2.
TYPE_RANK = {"Cytokine": 4, "Molecule": 3, "Gene": 3, "Drug": 3, "Tissue": 3, "Cell_type": 3, "Cell": 2, "Clinical_phenotype": 1}

#: Motifs: name, category and nodes in order.
ARCHITECTURES = [
    ("Epithelial alarmin → ILC2 → Type 2 cytokine loop", "barrier-immune loop", ["Airway epithelium", "IL-33", "ILC2", "IL-5", "Eosinophil"]),
    ("TSLP-dendritic-Th2 axis", "immune education loop", ["Airway epithelium", "TSLP", "Dendritic cell", "Th2 cell", "IL-4"]),
    ("IL-4/IL-13 effector axis", "positive feedback loop", ["Th2 cell", "IL-4", "Th2 cell"]),
    ("IL-5 eosinophil amplification", "immune amplification loop", ["ILC2", "IL-5", "Eosinophil", "Airway inflammation"]),
    ("Tissue-resident memory chronicity loop", "memory loop", ["Batf3", "Dendritic cell", "Tissue-resident memory T cell", "Airway inflammation"]),
    ("Mast cell-IgE effector loop", "effector loop", ["Allergen", "IgE", "Mast cell", "Airway inflammation"]),
    ("Bone marrow eosinophilopoiesis axis", "bone marrow communication", ["IL-5", "Bone marrow", "Eosinophil"]),
    ("IL-13 remodeling axis", "chronic inflammation loop", ["Th2 cell", "IL-13", "Airway remodeling"]),
    ("Biologic intervention (anti-TSLP)", "therapeutic interruption", ["Tezepelumab", "TSLP", "Type 2 inflammation"]),
    ("Biologic intervention (anti-IL-4R)", "therapeutic interruption", ["Dupilumab", "Type 2 inflammation", "Airway inflammation"]),
]

#: Categories of loops, the first that fits: a loop has all members of one of the sets.
LOOP_RULES = [
    ("bone_marrow_tissue_loop", [["IL-5", "Eosinophil", "Bone marrow"]]),
    ("cytokine_amplification", [["IL-33", "ILC2"], ["TSLP", "Dendritic cell"]]),
    ("immune_memory_loop", [["Tissue-resident memory T cell", "Airway inflammation"], ["Batf3"]]),
    ("fibrosis_feedback", [["Fibroblast", "IL-11"], ["TGF-beta", "IL-11"]]),
]
OTHER_LOOPS = "positive_feedback"

#: Claim templates: source, relation, target, pattern over the lower-cased abstract.
TEMPLATES = [
    ("Airway epithelium", "induces", "TSLP", r"epithelial.*?(?:release|produce|express).*?tslp|tslp.*?(?:from|by).*?epitheli"),
    ("Airway epithelium", "induces", "IL-33", r"epithelial.*?(?:release|produce|express).*?il-?33|il-?33.*?(?:from|by).*?epitheli"),
    ("TSLP", "activates", "Dendritic cell", r"tslp.*?(?:activate|stimulat).*?dendritic"),
    ("IL-33", "activates", "ILC2", r"il-?33.*?(?:activate|stimulat).*?ilc2|ilc2.*?(?:activate|stimulat).*?il-?33"),
    ("IL-33", "activates", "ILC2", r"il-?33.*?st2|st2.*?il-?33"),
    ("ILC2", "induces", "IL-5", r"ilc2.*?(?:produce|secre|express).*?il-?5|il-?5.*?(?:from|by).*?ilc2"),
    ("ILC2", "induces", "IL-13", r"ilc2.*?(?:produce|secre|express).*?il-?13|il-?13.*?(?:from|by).*?ilc2"),
    ("Th2 cell", "induces", "IL-4", r"th2.*?(?:produce|secre|express).*?il-?4"),
    ("Th2 cell", "induces", "IL-5", r"th2.*?(?:produce|secre|express).*?il-?5"),
    ("Th2 cell", "induces", "IL-13", r"th2.*?(?:produce|secre|express).*?il-?13"),
    ("IL-5", "recruits", "Eosinophil", r"il-?5.*?(?:recruit|expand|eosinophil)|eosinophil.*?(?:recruit|expand).*?il-?5"),
    ("IL-4", "activates", "Th2 cell", r"il-?4.*?(?:promot|driv|polariz).*?th2|th2.*?il-?4"),
    ("IL-13", "induces", "Mucus hypersecretion", r"il-?13.*?(?:mucus|goblet|hypersecret)"),
    ("IL-13", "induces", "Airway remodeling", r"il-?13.*?(?:remodel|fibrosis|fibroblast)"),
    ("IgE", "activates", "Mast cell", r"ige.*?(?:activat|bind|cross-link).*?mast|mast.*?ige"),
    ("Mast cell", "induces", "Airway inflammation", r"mast cell.*?(?:inflamm|mediator|histamine|leukotriene)"),
    ("Allergen", "activates", "Th2 cell", r"allergen.*?(?:sensitiz|th2|ige)"),
    ("Batf3", "activates", "Dendritic cell", r"batf3.*?(?:c?dc1|dendritic)"),
    ("Batf3", "activates", "Tissue-resident memory T cell", r"batf3.*?(?:resident memory|trm|cd4\+.*?resident)"),
    ("Tissue-resident memory T cell", "induces", "Airway inflammation", r"(?:resident memory|trm).*?(?:inflamm|airway hyperrespons)"),
    ("Tissue-resident memory T cell", "induces", "Airway hyperresponsiveness", r"(?:resident memory|trm).*?(?:hyperrespons|ahr)"),
    ("Dupilumab", "suppresses", "Type 2 inflammation", r"dupilumab.*?(?:reduc|inhibit|suppress|block).*?(?:type.?2|il-?(?:4|5|13))"),
    ("Mepolizumab", "suppresses", "Eosinophil", r"mepolizumab.*?(?:reduc|deplet|eosinophil)"),
    ("Benralizumab", "suppresses", "Eosinophil", r"benralizumab.*?(?:reduc|deplet|eosinophil)"),
    ("Tezepelumab", "suppresses", "TSLP", r"tezepelumab.*?(?:block|inhibit|tslp)"),
    ("Omalizumab", "suppresses", "IgE", r"omalizumab.*?(?:ige|immunoglobulin)"),
    ("GATA3", "activates", "Th2 cell", r"gata3.*?(?:th2|t helper 2)"),
    ("IL-4", "activates", "GATA3", r"il-?4.*?gata3|gata3.*?il-?4"),
    ("STAT6", "activates", "GATA3", r"stat6.*?gata3|gata3.*?stat6"),
    ("Neutrophil", "induces", "Airway inflammation", r"neutrophil.*?(?:inflamm|neutrophilic)"),
    ("Type 2 inflammation", "induces", "Eosinophil", r"type.?2.*?(?:eosinophil|il-?5)"),
    ("Eosinophil", "induces", "Airway remodeling", r"eosinophil.*?(?:remodel|tissue damage|structural)"),
    ("House dust mite", "activates", "Airway epithelium", r"(?:house dust mite|hdm).*?(?:epithel|alarm)"),
    ("Bone marrow", "recruits", "Eosinophil", r"bone marrow.*?(?:eosinophil|eosinophilopoiesis|hematopoies)"),
    ("IL-5", "activates", "Bone marrow", r"il-?5.*?(?:bone marrow|eosinophilopoiesis)"),
    ("Trained immunity", "activates", "Innate immune cell", r"trained immunity.*?(?:innate|monocyte|macrophage)"),
    ("Airway epithelium", "induces", "IL-25", r"epithelial.*?il-?25|il-?25.*?epithel"),
    ("IL-25", "activates", "ILC2", r"il-?25.*?ilc2|ilc2.*?il-?25"),
    ("Fibroblast", "induces", "Airway remodeling", r"fibroblast.*?(?:remodel|collagen|extracellular matrix)"),
    ("Airway smooth muscle", "induces", "Airway hyperresponsiveness", r"smooth muscle.*?(?:hyperrespons|bronchoconstrict)"),
]
