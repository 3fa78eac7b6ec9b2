"""Prompt templates, markers and thresholds."""

ENSEMBLE_TEMPLATE = """You are a radiologist. Write a chest X-ray report.

[Context]
{kg_context}

[History]
{history}

[Report]
FINDINGS:"""

SINGLE_TEMPLATE = """<start_of_turn>user
You are an expert radiologist. Write a professional chest X-ray report.

[Context]
{kg_context}

[Patient History]
{history}

Write the findings section for this case.<end_of_turn>
<start_of_turn>model
FINDINGS:"""

TRAINING_TEMPLATE = """You are an expert radiologist.
Patient History:
{history}

Task:
Write a professional chest X-ray report (Findings and Impression) based on the image and history above.
Report:
"""

NO_HISTORY = "No prior history."
NO_HISTORY_TRAINING = "No prior history available."
NO_CONTEXT = "No additional context."
HISTORY_MARKER = "[PATIENT MEDICAL HISTORY]"
REFERENCE_LEAD = "Reference patterns from similar cases:"

GATE_THRESHOLD = 0.15
HIGH_CONFIDENCE = 0.85
SUPPORT_DEVICES_CONFIDENCE = 0.5

# (name, retrieval context, disease context)
STRATEGIES = (
    ("Vis+Hist", False, False),
    ("Vis+Hist+KG1", True, False),
    ("Vis+Hist+KG2", False, True),
    ("Vis+Hist+KG1+KG2", True, True),
)

SELECTION_WEIGHTS = {"RadGraph_F1": 0.4, "CheXpert_F1": 0.4, "BLEU-4": 0.2}
