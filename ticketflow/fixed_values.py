"""Constants of the ticket domain: labels, class quotas, texts, thresholds."""

# The label order defines label ids 0..5.
LABELS = (
    "technical",
    "account",
    "billing",
    "general",
    "feature_request",
    "cancellation",
)

# Rows per class of the generated ticket table.
CLASS_QUOTAS = {
    "technical": 1500,
    "account": 1200,
    "billing": 900,
    "general": 700,
    "feature_request": 450,
    "cancellation": 250,
}

# Ticket templates per class, with an optional slot.
TEMPLATES = {
    "technical": (
        "The application crashes when I {action}.",
        "I am getting an error when I try to {action}.",
        "The system stops working whenever I {action}.",
        "There is a bug preventing me from {action}.",
        "The application is not working correctly when I {action}.",
        "I keep receiving an error while trying to {action}.",
        "The software freezes when I {action}.",
        "Something is broken and I cannot {action}.",
    ),
    "account": (
        "I cannot log into my account.",
        "I forgot my password and cannot access my account.",
        "How can I change my password?",
        "I need to update the email address on my profile.",
        "I cannot access my account after changing my password.",
        "How do I change my account permissions?",
        "My account is locked and I cannot sign in.",
        "I need help updating my profile information.",
    ),
    "billing": (
        "I was charged twice for my subscription.",
        "I do not recognize a charge on my account.",
        "Why was I charged for this month?",
        "My payment was declined.",
        "I need a copy of my invoice.",
        "How can I change my payment method?",
        "The subscription price on my invoice is incorrect.",
        "I was charged the wrong amount.",
    ),
    "general": (
        "Can you give me more information about the service?",
        "Where can I find more information about this product?",
        "How does the platform work?",
        "I have a general question about the service.",
        "Can you explain how this works?",
        "Where can I find the documentation?",
        "I would like more information about your plans.",
        "Can you tell me more about the platform?",
    ),
    "feature_request": (
        "I would like the platform to support {feature}.",
        "Could you add {feature} to the application?",
        "It would be useful to have {feature}.",
        "I would like to request a new feature for {feature}.",
        "Please consider adding {feature} in a future update.",
        "Is it possible to add {feature}?",
        "I think the platform would be better with {feature}.",
        "Could you implement {feature}?",
    ),
    "cancellation": (
        "I want to cancel my subscription.",
        "How can I cancel my account?",
        "I would like to cancel my plan.",
        "Please help me cancel my subscription.",
        "I want to stop using the service.",
        "I do not want to renew my subscription.",
        "How do I terminate my subscription?",
        "I want to close my account and cancel the service.",
    ),
}

# What may fill each template slot.
SLOTS = {
    "action": (
        "upload a file",
        "open a document",
        "save a project",
        "export a report",
        "generate a document",
        "import data",
        "download a file",
        "open the dashboard",
    ),
    "feature": (
        "dark mode",
        "bulk file uploads",
        "a mobile application",
        "advanced reporting",
        "custom notifications",
        "calendar integration",
        "additional export formats",
        "an improved search system",
    ),
}

# Annotator confidence and its integer weights, by class.
CONFIDENT_CLASSES = ("technical", "account", "billing")
CONFIDENT_VALUES, CONFIDENT_WEIGHTS = (3, 4, 5), (10, 35, 55)
OTHER_VALUES, OTHER_WEIGHTS = (2, 3, 4, 5), (10, 25, 40, 25)

# Ten labelled texts that were not generated from templates.
NEW_EXAMPLES = (
    ("The application crashes every time I try to upload a document.", "technical"),
    ("I need to change the email address associated with my account.", "account"),
    ("I was charged twice for the same subscription this month.", "billing"),
    ("I would like to know what documents are required to register.", "general"),
    ("It would be useful to have a dark mode in the application.", "feature_request"),
    ("Please cancel my subscription immediately.", "cancellation"),
    ("I cannot cancel my subscription because the button does not work.", "cancellation"),
    ("I was charged for a service that I want to cancel.", "cancellation"),
    ("The website is not loading and I cannot access my account.", "technical"),
    ("Can I get a refund for the payment I made yesterday?", "billing"),
)

# Unlabelled texts for trying a model.
DEMO_TEXTS = (
    "My application crashes when I try to open it.",
    "I want to cancel my subscription.",
    "I was charged twice this month.",
    "I would like to request a new dark mode feature.",
    "I don't know what documents I need to register.",
    "The website is not loading and I cannot access my account.",
)

# Settings every step shares.
SEED = 42
THRESHOLD = 0.8
AUTOMATIC, HUMAN_REVIEW = "automatic", "human_review"
OK, ERROR = "OK", "ERROR"
MAX_LENGTH = 128
BATCH_SIZE = 32
ROUNDS = 5
PATIENCE = 2
MONTHLY_COST = 15000.0

# Reserved tokens, ids 0..3; learned ids follow.
PAD, UNK, CLS, SEP = "[PAD]", "[UNK]", "[CLS]", "[SEP]"
RESERVED_TOKENS = (PAD, UNK, CLS, SEP)
