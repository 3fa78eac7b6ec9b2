"""Keyword lists and keyword rules."""

# a past diagnosis is relevant when its description holds one of these substrings
RELEVANCE_KEYWORDS = (
    "heart", "cardiac", "cardio", "myocardial", "pericardium", "coronary", "atrial", "aortic", "mitral", "valve",
    "cardiomegaly", "hypertension", "aneurysm",
    "lung", "pulmonary", "pneumonia", "thoracic", "pleural", "pneumothorax", "bronchus", "trachea",
    "edema", "effusion", "embolism", "atelectasis", "consolidation", "opacity", "hilar", "mediastinal",
    "diaphragm", "esophagus", "rib", "spine", "clavicle", "sternum",
    "respiratory", "breath", "airway", "dyspnea", "apnea", "hypoxia", "hypoxemia",
    "copd", "emphysema", "asthma", "bronchiectasis", "fibrosis", "interstitial",
    "tuberculosis", "tb",
    "cancer", "carcinoma", "tumor", "mass", "nodule", "neoplasm", "malignancy",
    "metastasis", "metastatic", "nodular",
    "renal", "kidney",
    "vascular", "vessel", "aorta", "svc", "venous", "artery",
    "thrombus", "thrombosis",
    "infiltrate", "infiltration", "calcification", "calcified",
    "cyst", "cystic", "cavity", "reticular",
    "congestion", "hemorrhage", "bleeding",
    "infarction", "ischemia", "ischemic",
    "inflammation", "inflammatory", "infection",
    "fracture", "enlarged", "enlargement",
    "lymph", "lymphadenopathy",
    "failure", "disease", "pain", "shortness",
    "acute", "chronic", "abnormal", "lesion",
)

UNKNOWN_TITLES = ("Unknown", "Unknown ICD Code")

# (keyword, finding), matched as substrings of lower-cased reports
FINDING_KEYWORDS = (
    ("effusion", "Pleural Effusion"),
    ("pleural effusion", "Pleural Effusion"),
    ("pleural fluid", "Pleural Effusion"),
    ("costophrenic angle", "Pleural Effusion"),
    ("cardiomegaly", "Cardiomegaly"),
    ("enlarged heart", "Cardiomegaly"),
    ("cardiac silhouette", "Cardiomegaly"),
    ("consolidation", "Consolidation"),
    ("airspace consolidation", "Consolidation"),
    ("opacity", "Lung Opacity"),
    ("opacities", "Lung Opacity"),
    ("airspace opacity", "Lung Opacity"),
    ("infiltrate", "Infiltrate"),
    ("infiltrates", "Infiltrate"),
    ("edema", "Pulmonary Edema"),
    ("pulmonary edema", "Pulmonary Edema"),
    ("vascular congestion", "Pulmonary Edema"),
    ("pneumothorax", "Pneumothorax"),
    ("collapsed lung", "Pneumothorax"),
    ("atelectasis", "Atelectasis"),
    ("volume loss", "Atelectasis"),
    ("nodule", "Nodule"),
    ("nodules", "Nodule"),
    ("mass", "Mass"),
    ("lung mass", "Mass"),
    ("emphysema", "Emphysema"),
    ("hyperinflation", "Hyperinflation"),
    ("ascites", "Ascites"),
    ("ards", "ARDS"),
)

# (label, words): the first rule with a hit gives the diagnosis of a study
DIAGNOSIS_RULES_PATCH = (
    ("Pneumothorax", ("pneumothorax",)),
    ("Effusion", ("pleural effusion", "effusion")),
    ("Cardiomegaly", ("cardiomegaly", "enlarged heart")),
    ("Pneumonia", ("pneumonia",)),
    ("Edema", ("edema",)),
    ("Fracture", ("fracture",)),
    ("Consolidation", ("consolidation",)),
    ("Atelectasis", ("atelectasis",)),
    ("Normal", ("no acute", "unremarkable", "normal")),
)
DIAGNOSIS_RULES_POOLED = (
    ("Pneumothorax", ("pneumothorax",)),
    ("Pneumonia", ("pneumonia",)),
    ("Edema", ("edema",)),
    ("Cardiomegaly", ("cardiomegaly",)),
    ("Effusion", ("pleural effusion",)),
    ("Atelectasis", ("atelectasis",)),
    ("Consolidation", ("consolidation",)),
    ("Fracture", ("fracture",)),
    ("Nodule/Mass", ("nodule", "mass")),
    ("Normal", ("no acute", "no active disease", "normal")),
)
