"""Word lists. Every function that uses one takes it as a parameter; these are the defaults."""

# Words that tokenisation drops.
STOPWORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had",
    "do", "does", "did", "will", "would", "could", "should", "may", "might", "shall", "can",
    "for", "and", "but", "or", "nor", "not", "so", "yet", "to", "of", "in", "on", "at", "by",
    "with", "from", "as", "into", "through", "during", "before", "after", "above", "below",
    "between", "each", "all", "both", "such", "that", "this", "these", "those", "it", "its",
    "they", "them", "their", "which", "who", "including", "based", "also", "other", "than", "any", "more",
)

# Clause types that make a clause a requirement.
REQUIREMENT_TYPES = ("requirement", "mandatory", "shall", "normative", "required", "objective", "base practice", "generic practice", "control")

# Short lower-case words that are concepts all the same.
SHORT_CONCEPTS = ("dfa", "fta", "fsc", "tsc", "hsi", "ecu")

# Statuses of a finished work product.
FINISHED = ("complete", "approved", "final", "released")

# Words that clause tags are made of.
TAG_KEYWORDS = (
    "safety", "hazard", "risk", "assessment", "analysis", "requirement", "verification", "validation", "review", "audit", "design", "testing",
    "failure", "mitigation", "control", "measure", "specification", "traceability", "decomposition", "independence", "integration",
    "calibration", "diagnostic", "monitoring", "redundancy", "diversity",
)

# Acronyms that are tags.
TAG_ACRONYMS = (
    "FMEA", "FMEDA", "FTA", "FMECA", "ETA", "HAZOP", "DFA", "CCA", "RBD", "DRBFM", "ASIL", "SIL", "HARA", "FSC", "TSC", "TSR", "FSR", "HSI", "SOTIF", "ODD",
    "SPFM", "LFM", "PMHF", "FTTI", "MPFDI", "FDTI", "AUTOSAR", "CMMI", "ASPICE", "MISRA", "BIST", "ECC", "CRC", "WDT", "EDC", "LBIST", "MBIST",
    "QMS", "PDCA", "CAPA", "DVP", "PPAP", "PFMEA", "DFMEA", "APQP", "ABS", "ESC", "ESP", "ACC", "AEB", "ADAS", "EPS", "EPB", "BCM", "ECU", "TCU",
    "LIN", "DIA", "COTS", "GSN", "CAE", "SRS", "SDD", "STP", "STR", "SVP",
)

# Acronyms that are tags only where they are emphasised.
EMPHASISED_ACRONYMS = ("CAN", "SPI")

# Names of analysis and test methods that texts are searched for.
METHOD_TERMS = (
    "hara", "hazard analysis", "hazard analysis and risk assessment", "fmea", "failure modes and effects analysis", "fmeda",
    "failure modes and effects diagnostics analysis", "fta", "fault tree analysis", "fault tree", "hazop", "hazard and operability", "dfa",
    "design failure analysis", "fea", "finite element analysis", "cea", "common cause analysis", "sneak circuit analysis", "sneak", "emi analysis",
    "electromagnetic interference", "thermal analysis", "shock and vibration analysis", "stress analysis", "code review", "static analysis",
    "dynamic testing", "unit testing", "integration testing", "system testing", "acceptance testing", "regression testing", "simulation",
    "model checking", "theorem proving", "formal verification", "walkthrough", "inspection", "technical review", "management review", "appraisal", "assessment",
)

# Concepts that texts are searched for.
CONCEPT_TERMS = (
    "asil", "safety goal", "safety requirement", "hazard", "hazard analysis", "hara", "fmea", "fmeda", "fta", "fault tree", "single point failure",
    "spf", "latent fault", "diagnostic coverage", "metric", "dcm", "dcmin", "mpf", "safe state", "safe system state", "residual risk",
    "analysis", "verification", "validation", "testing", "review", "walkthrough", "inspection", "simulation", "model checking",
    "theorem proving", "formal verification", "code review", "hardware", "software", "middleware", "firmware", "architecture",
    "soc", "sub", "component", "interface", "requirement", "specification", "design", "implementation", "integration", "test", "qualification",
    "concept", "planning", "development", "production", "operation", "maintenance", "decommissioning", "lifecycle", "phase", "stage",
    "risk", "severity", "probability", "occurrence", "failure", "failure mode", "failure rate", "mission time", "fault", "error",
    "defect", "anomaly", "degradation", "malfunction", "unavailability", "vehicle", "ecu", "ecus", "sensor", "actuator", "control",
    "braking", "steering", "powertrain", "stability", "dynamics", "perception", "decision", "execution", "brake",
    "throttle", "transmission", "engine", "battery", "charging", "test case", "test plan", "test report", "traceability",
    "matrix", "mapping", "allocate", "allocation", "allocation document", "quality", "quality assurance", "qa", "process", "procedure",
    "measurement", "audit", "assessment", "compliance", "standard", "norm", "regulation", "directive",
    "configuration", "version", "release", "patch", "update", "change", "change management", "baseline", "milestone",
    "safety plan", "management", "organization", "responsibility", "competence", "training", "documentation", "evidence",
    "case", "dossier", "appraisal",
)

# Names that fields of each role go by.
FIELD_ROLES = {
    "text": ("text", "description", "content", "requirement", "statement", "clause_text", "body", "guidance", "definition", "purpose", "objective", "criteria", "specification"),
    "id": ("section", "clause_id", "id", "clause", "requirement_id", "ref", "reference", "number", "annex", "process_id", "practice_id", "control_id", "wp_id"),
    "title": ("title", "name", "heading", "label", "subject", "topic", "activity"),
    "risk": ("asil_level", "asil", "sil", "cal", "cal_level", "capability_level", "level", "integrity_level", "risk_level", "criticality", "assurance_level", "security_level", "dal", "eal", "tql"),
    "tag": ("tags", "keywords", "topics", "categories", "concepts", "labels", "domains", "areas", "attributes", "aspects"),
    "method": ("methods", "techniques", "practices", "measures", "controls", "activities", "recommendations", "tools", "procedures", "approaches"),
    "xref": ("cross_references", "references", "xrefs", "links", "related", "dependencies", "traceability_links", "mapping", "traces", "derives_from", "satisfies", "cross_part_links"),
    "type": ("type", "kind", "category", "classification", "nature", "status", "obligation"),
}
