"""Fixed values of the service-desk data model.

Everything here is data that results depend on literally: ids, labels,
patterns and texts.  Code that uses them lives in ``operators``.
"""

LOCAL_ZONE = "Europe/Paris"

# Urgency ids. Any other id scores nothing.
URGENCY_MAJEUR = 1
URGENCY_IMPORTANT = 2
URGENCY_SENSIBLE = 3
URGENCY_NORMAL = 5
URGENCY_NAMES = {
    URGENCY_NORMAL: "Normal",
    URGENCY_SENSIBLE: "Sensible",
    URGENCY_IMPORTANT: "Important",
    URGENCY_MAJEUR: "Majeur",
}

# Ticket types.
INCIDENT = 0
REQUEST = 1
TICKET_TYPE_NAMES = {REQUEST: "Demande", INCIDENT: "Incident"}
REQUEST_RFC_PREFIX = "D"

# Intervention types.
INTERVENTION_UNCLASSIFIED = 1
INTERVENTION_HOTLINE = 2
INTERVENTION_PROXY = tuple(range(3, 17))

# Status sets. The three suspended sets differ on purpose.
STATUS_SUSPENDED = (5, 20, 39, 42)
STATUS_SUSPENDED_FOR_SCORE = (5, 20, 39)
STATUS_SUSPENDED_BY_TECHNICIAN = (5, 20)
STATUS_SUSPENDED_BY_MAIL = (39, 42)
STATUS_CLOSED = (2, 7, 8, 11, 15, 18, 21, 25, 26, 27, 28, 30, 33)

# Action type sets.
ACTION_ASSIGNMENT = (20, 21, 32, 34, 37, 38, 50, 52, 54)
ACTION_NOT_WORK = (1, 2, 22, 23, 39, 42, 104, 107, 111)
ACTION_PILOT_NOTE = (65, 108)
ACTION_OBSERVATION = 108
ACTION_SUSPENSION = 5
ACTION_NOT_EXTRACTED = (23, 107, 82)

# Extraction keys.
GROUP_HOTLINE = 5
CATALOG_NEW_ARRIVAL = 5535
CATALOG_SOFTWARE_INSTALL = (
    5687, 5564, 5573, 5577, 5578, 5580, 5581, 5582, 5583, 5584, 5593, 5594,
    5595, 5597, 5598, 5599, 5600, 5601, 5602, 5603, 5604, 5606, 5607, 5608,
    5793, 5609, 5610, 5611, 5613, 5614, 5729, 5616, 5680, 5398, 5686, 5691,
    5690, 5840, 5757, 5758, 5759, 5760, 5796, 5836, 5837, 5846, 5617,
)
REQUEST_IDS_KNOWN_BAD = (188214, 185394)

# Configuration items and text patterns of the selectors.
CI_ID_SECURITY = (9926, 8696)
CI_INDUSTRIAL = ("POSTES INDUSTRIELS_ENV", "Mustang_Mobilité_ENV")
CI_DIGIPASS = ("DIGIPASS", "TELETRAVAIL_ENV", "Azure.Microsoft")
CI_SKYPE = ("SKYPE_ENV",)
CI_OUTLOOK = ("OUTLOOK_APP", "MESSAGERIE_ENV", "WEBMAIL_APP",
              "FILTRAGE_MAIL_ENV", "OFFICE_APP")
CI_TELEPHONE = ("TELEPHONIE_MOBILE_ENV", "TELEPHONIE_ENV")
PATTERN_SECURITY = "(anti)?virus|^vol.?$|pirat(é|e)|malware|(mc)?afee"
PATTERN_INDUSTRIAL = "scada|tablette|conduite"
PATTERN_DIGIPASS = "big.?ip|vpn"
PATTERN_CONTACT = ("Appel sortant utilisateur|Notification au demandeur|"
                   "Relance vers l'utilisateur|Envoi de mail au demandeur")
PATTERN_RDV_DATE = "((?<=:)[0-9]{2}.[0-9]{2}.[0-9]{4})"
PATTERN_HTML_TAG = "<[^<]+?>"
PATTERN_GREETING = "bonjour.?"
TAG_RDV = "#tagp# rdv:"
TAG_OBSERVATION = "#tagp# sousobservation"

# Fill-ins and states.
FILL_NAME = "N/A"
FILL_URGENCY = "4-Normal"
FILL_LOCATION = "Pas de location"
RDV_NONE = "Pas de RDV"
RDV_INVALID = "RDV - date invalide"
RDV_PENDING = "RDV - en cours"
RDV_LATE = "RDV - en retard"

# Bonus points and the texts that justify them.
SECURITY_POINTS = 1000
SECURITY_TEXT = "+1000 pts ticket sécurité "
VIP_BASE, VIP_PER_DAY = 500, 100
VIP_TEXT = "1000 base + 100 pts/day ticket VIP depuis dernière action "
INDUSTRIAL_POINTS = 500
INDUSTRIAL_TEXT = "500 points pour poste industriel"
JUSTIFICATION_SEPARATOR = " // "

# Fixed values: (urgency, ticket type) -> (base, points per day).
RATE_SINCE_CREATION = {
    (URGENCY_NORMAL, REQUEST): (0, 1),
    (URGENCY_NORMAL, INCIDENT): (1, 3),
    (URGENCY_SENSIBLE, REQUEST): (3, 3),
    (URGENCY_SENSIBLE, INCIDENT): (10, 10),
    (URGENCY_IMPORTANT, REQUEST): (30, 30),
    (URGENCY_IMPORTANT, INCIDENT): (100, 100),
    (URGENCY_MAJEUR, REQUEST): (300, 300),
    (URGENCY_MAJEUR, INCIDENT): (1000, 1000),
}
RATE_SINCE_LAST_ACTION = {
    (URGENCY_NORMAL, REQUEST): (0, 1),
    (URGENCY_NORMAL, INCIDENT): (0, 3),
    (URGENCY_SENSIBLE, REQUEST): (0, 3),
    (URGENCY_SENSIBLE, INCIDENT): (0, 10),
    (URGENCY_IMPORTANT, REQUEST): (0, 30),
    (URGENCY_IMPORTANT, INCIDENT): (0, 100),
    (URGENCY_MAJEUR, REQUEST): (0, 300),
    (URGENCY_MAJEUR, INCIDENT): (0, 1000),
}
RATE_NOT_SUSPENDED = {
    (URGENCY_NORMAL, REQUEST): (0, 10),
    (URGENCY_NORMAL, INCIDENT): (0, 25),
    (URGENCY_SENSIBLE, REQUEST): (0, 25),
    (URGENCY_SENSIBLE, INCIDENT): (0, 50),
    (URGENCY_IMPORTANT, REQUEST): (0, 50),
    (URGENCY_IMPORTANT, INCIDENT): (0, 100),
    (URGENCY_MAJEUR, REQUEST): (0, 300),
    (URGENCY_MAJEUR, INCIDENT): (0, 1000),
}
REASON_SINCE_CREATION = "depuis creation"
REASON_SINCE_LAST_ACTION = "depuis dernière action"
REASON_NOT_SUSPENDED = "non suspendu"

# Raw location -> displayed location.
LOCATIONS = {
    "CNR DIR REGION BELLEY": "DHR Belley",
    "CNR AMGT BELLEY-BREG CORD": "DHR Bregnier-Cordon",
    "CNR AMGT GENISSIAT": "DHR Genissiat",
    "CNR AMGT SAULT BRENAZ-LOY": "DHR Sault Brenaz",
    "CNR AMGT SEYSSEL-CHAUTAGN": "DHR Seyssel",
    "CNR SIEGE SOCIAL": "DM Siege",
    "CNR DELEGATION DE PARIS": "DM Paris",
    "CNR LABORATOIRE GERLAND": "DM CACOH",
    "CNR PORT EDOUARD HERRIOT": "DM PLEH",
    "CNR USINE PIERRE BENITE": "DM Pierre Benite",
    "CNR DIR REGION VIENNE": "DRS Vienne",
    "CNR JEAN BART": "DRS Jean Bart",
    "Bureau MAINTENANCE": "DRS Jean Bart",
    "CNR USINE DE GERVANS": "DRS Gervans",
    "CNR USINE DE SABLONS": "DRS Sablons",
    "CNR USINE DE VAUGRIS": "DRS Vaugris",
    "CNR DIR REGION VALENCE": "DRI Valence",
    "CNR USINE BOURG LES VALENCE": "DRI Bourg-les-Valences",
    "CNR USINE DE LOGIS NEUF": "DRI Logis-Neuf",
    "CNR USINE DE CHATEAUNEUF": "DRI CH9",
    "CNR USINE DE BEAUCHASTEL": "DRI Beauchastel",
    "CNR DIR REGION AVIGNON": "DRM Avignon",
    "CNR USINE D AVIGNON": "DRM Usine Avignon",
    "CNR USINE DE BEAUCAIRE": "DRM Beaucaire",
    "CNR USINE DE BOLLENE": "DRM Bollene",
    "CNR USINE DE CADEROUSSE": "DRM Caderousse",
    "CNR USINE DE BARCARIN": "DRM Barcarin",
}

# Displayed location prefix -> calendar colour.
RDV_COLORS = {
    "DM": "#F1C40F",
    "DHR": "#3498DB",
    "DRS": "#8E44AD",
    "DRI": "#E67E22",
    "DRM": "#27AE60",
    "Paris": "#34495E",
    "Pas de location": "#FC0B03",
}

# Questionnaire question id -> answer column.
QUESTIONS = {
    45: "NOM",
    46: "PRENOM",
    48: "LOCATION",
    49: "CONTRACT",
    50: "ARRIVAL_DATE",
    55: "PC_PRESENT",
    58: "TELEPHONE",
}
