"""The fourteen report labels. Everything joins on the label name, never on a position."""

# column order of the label files
DATASET_ORDER = (
    "Atelectasis", "Cardiomegaly", "Consolidation", "Edema", "Enlarged Cardiomediastinum", "Fracture", "Lung Lesion",
    "Lung Opacity", "No Finding", "Pleural Effusion", "Pleural Other", "Pneumonia", "Pneumothorax", "Support Devices",
)

# order of the evaluation and of the prompt rules
EVALUATION_ORDER = (
    "Enlarged Cardiomediastinum", "Cardiomegaly", "Lung Opacity", "Lung Lesion", "Edema", "Consolidation", "Pneumonia",
    "Atelectasis", "Pneumothorax", "Pleural Effusion", "Pleural Other", "Fracture", "Support Devices", "No Finding",
)

NO_FINDING = "No Finding"
SUPPORT_DEVICES = "Support Devices"
SUPPORT_DEVICES_TEXT = "Support Devices (Tubes/Lines)"

# labels whose findings are kept whatever their probability
CRITICAL = ("Cardiomegaly", "Edema", "Pneumothorax", "Pleural Effusion")

# (substring, label, critical): used where no label name is contained in a finding
FUZZY = (
    ("edema", "Edema", True),
    ("effusion", "Pleural Effusion", True),
    ("pneumonia", "Pneumonia", False),
    ("consolidation", "Consolidation", False),
    ("opacity", "Lung Opacity", False),
    ("infiltrate", "Lung Opacity", False),
    ("atelectasis", "Atelectasis", False),
)
