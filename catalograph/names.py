"""Namespaces, the declared vocabulary and other fixed values of the data model."""

from __future__ import annotations

BASE = "https://media.example/"
MEDIA_NS = BASE + "cat/"
VOCAB = BASE + "ontology/cat/"
DC = "http://purl.org/dc/elements/1.1/"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDF_TYPE = RDF + "type"
XSD = "http://www.w3.org/2001/XMLSchema#"
GRAPH = MEDIA_NS + "NamedGraph/cat"
PREFIXES = {"cat": VOCAB, "dc": DC, "rdf": RDF, "xsd": XSD,
            "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "owl": "http://www.w3.org/2002/07/owl#"}
DEFAULT_PREFIX = "cat"

QUAD_COLS = ["store", "s", "p", "o", "o_kind", "dt", "g"]
QUAD_SCHEMA = "store string, s string, p string, o string, o_kind string, dt string, g string"

# --- fixed values -------------------------------------------------------------------------------
# Names, ranges and limits below are part of the data model: answers depend on their exact spelling.

STAGE_LINKS = {
    "embed": "vectorData",
    "caption": "captionData",
    "pose": "poseData",
    "segment": "regionData",
    "depth": "depthData",
    "face": "faceData",
}
STATE_STAGES = ["embed", "caption", "pose", "segment"]
LINKS = list(STAGE_LINKS.values())
OWNED_LINKS = ["thumbnail", "captionData", "vectorData", "poseData", "regionData", "depthData", "faceData"]
REF_FILE_FIELDS = ["path", "modelReplyPath"]
ITEM_FILE_FIELDS = ["vectorPath", "depthMapPath", "overlayPath", "maskPath"]

SCENE_FIELDS = [
    "sceneCamera", "sceneFraming", "scenePosture", "sceneGaze", "sceneExpression", "sceneAction",
    "sceneEnergy", "sceneMood", "sceneLighting", "sceneStyle", "sceneMedium", "sceneLocation",
    "sceneSubjectOrientation",
]
JUDGEMENT_FIELDS = [
    "imageTechnicalScore", "imageTechnicalCritique", "imageAestheticScore", "imageAestheticCritique",
    "imageAnatomyScore", "imageAnatomyCritique",
]
PERCEPTION_FIELDS = ["shortCaption", "longCaption", "sceneObjects", *SCENE_FIELDS, *JUDGEMENT_FIELDS,
                     "modelPromptPath"]
STRUCTURAL_FIELDS = [
    "mediaPath", "mediaType", "sourceFile", "imageSha256Hash", "width", "height", "createdDate",
    "updatedDate", "mediaCreatedDate", "enrichmentCompleteDate", "renderRequestInformation",
]
PRODUCER_DATES = ["mediaCreatedDate", "renderRequestDate"]
PRODUCER_ALLOWED = ["relatedToId", "mediaCreatedDate", "renderRequestDate"]

# Declared datatype properties by domain: (name, range); a bare range is an xsd type.
DATATYPE_PROPERTIES: dict[str, list[tuple[str, str]]] = {
    "Node": [
        ("bbox", "string"), ("createdDate", "dateTime"), ("description", "string"), ("dim", "integer"),
        ("height", "integer"), ("model", "string"), ("modelPromptPath", "string"), ("path", "string"),
        ("precision", "string"), ("producedDate", "dateTime"), ("provider", "string"),
        ("score", "decimal"), ("updatedDate", "dateTime"), ("vectorPath", "string"), ("width", "integer"),
    ],
    "Media": [
        ("enrichmentCompleteDate", "dateTime"), ("isPicked", "boolean"), ("isRejected", "boolean"),
        ("longCaption", "string"), ("mediaCreatedDate", "dateTime"), ("mediaPath", "string"),
        ("mediaType", "string"), ("rating", "RatingValue"), ("renderPrompt", "string"),
        ("renderRequestDate", "dateTime"), ("renderRequestInformation", "string"),
        ("shortCaption", "string"), ("sourceFile", "string"),
    ],
    "Image": [
        ("imageAestheticCritique", "string"), ("imageAestheticScore", "ScoreValue"),
        ("imageAnatomyCritique", "string"), ("imageAnatomyScore", "ScoreValue"),
        ("imageSha256Hash", "string"), ("imageTechnicalCritique", "string"),
        ("imageTechnicalScore", "ScoreValue"), ("sceneAction", "string"), ("sceneCamera", "string"),
        ("sceneEnergy", "string"), ("sceneExpression", "string"), ("sceneFraming", "string"),
        ("sceneGaze", "string"), ("sceneLighting", "string"), ("sceneLocation", "string"),
        ("sceneMedium", "string"), ("sceneMood", "string"), ("sceneObjects", "string"),
        ("scenePosture", "string"), ("sceneStyle", "string"), ("sceneSubjectOrientation", "string"),
    ],
    "Video": [("duration", "decimal"), ("frameRate", "decimal")],
    "Enrichment": [("modelReplyPath", "string")],
    "RegionData": [("count", "integer"), ("requestMinConfidence", "decimal"), ("requestNouns", "string"),
                   ("requestPolygonVerts", "integer")],
    "Region": [("descriptor", "string"), ("maskPath", "string"), ("polygon", "string")],
    "Pose": [("keypoints", "string"), ("overlayPath", "string")],
    "Caption": [("text", "string")],
    "Depth": [("depthMapPath", "string"), ("depthMax", "decimal"), ("depthMin", "decimal")],
    "Face": [("headPose", "string"), ("landmarks", "string")],
    "Store": [("mediaRoot", "string")],
    "Instance": [("fsRoot", "string"), ("instanceMode", "string"), ("listenPort", "integer"),
                 ("localGraph", "string"), ("primaryGraph", "string"), ("sourceFormat", "string")],
}
OBJECT_PROPERTIES = ["captionData", "depthData", "faceData", "id", "item", "poseData", "regionData",
                     "relatedToId", "thumbnail", "vectorData"]
BOUNDED_INTEGERS = {"RatingValue": (0, 5), "ScoreValue": (0, 100)}

# Cardinality per class: exactly one of, at most one of.
CARDINALITY: dict[str, tuple[list[str], list[str]]] = {
    "Media": (["id", "mediaPath", "mediaType", "sourceFile", "createdDate"],
              ["mediaCreatedDate", "enrichmentCompleteDate", "updatedDate", "width", "height", "thumbnail",
               "modelPromptPath", "imageSha256Hash", "renderRequestInformation", "renderPrompt",
               "renderRequestDate", *JUDGEMENT_FIELDS, "rating", "isPicked", "isRejected"]),
    "Video": ([], ["duration", "frameRate"]),
    "MediaSet": (["id", "createdDate"], ["updatedDate", "description"]),
    "Enrichment": (["id", "model", "path", "producedDate"], ["modelReplyPath"]),
    "RegionData": (["count"], ["requestNouns", "requestMinConfidence", "requestPolygonVerts"]),
    "Region": (["id", "model", "producedDate", "descriptor"], ["polygon", "bbox", "score", "maskPath"]),
    "Pose": (["id", "model", "producedDate", "keypoints"], ["overlayPath"]),
    "Caption": (["id", "model", "producedDate", "text"], ["modelPromptPath"]),
    "Embedding": (["id", "model", "producedDate", "dim", "vectorPath"], []),
    "Thumbnail": (["id", "path", "producedDate", "width", "height"], []),
    "Depth": (["id", "model", "producedDate", "depthMapPath", "depthMin", "depthMax"], ["width", "height"]),
    "Face": (["id", "model", "producedDate", "bbox", "score", "landmarks", "vectorPath", "dim"], ["headPose"]),
    "Store": (["id", "mediaRoot"], []),
    "Instance": (["id", "fsRoot", "instanceMode", "listenPort"], ["primaryGraph", "localGraph", "sourceFormat"]),
}
SUPERCLASS = {"Image": "Media", "Video": "Media", "ImageSet": "MediaSet", "VideoSet": "MediaSet",
              "AudioSet": "MediaSet", "RegionData": "Enrichment"}

SET_MEMBER = {"ImageSet": "Image", "VideoSet": "Video"}

ID_PATTERN = "^[A-Za-z0-9_-]{1,200}$"
ID_ALPHABET = "abcdefghijklmnopqrstuvwxyz234567"
INDEX_PATTERN = "^[A-Za-z0-9._-]{1,128}$"
MODEL_PATTERN = "^[a-z0-9]+(-[a-z0-9]+)*$"
HOLD_SECONDS = 600
RENDER_REQUEST_CHUNK = "parameters"  # keyword of the PNG text chunk that holds the whole request
BATCH = 24
SEARCH_EF = (64, 4096)
FACE_THRESHOLD = 0.4

MIME_BY_EXTENSION = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp", "gif": "image/gif",
                     "png": "image/png", "mp4": "video/mp4", "m4v": "video/mp4", "mov": "video/quicktime"}
EXTENSION_BY_MIME = {"image/png": "png", "image/jpeg": "jpg", "image/webp": "webp", "image/gif": "gif",
                     "image/tiff": "tiff", "video/mp4": "mp4", "video/quicktime": "mov"}

LEDGER_COLUMNS = ["when", "status", "source_path", "stem", "old_cid", "old_moment_id", "old_in_set_id",
                  "media_created_date", "store", "media_id", "media_path", "sidecar", "reason"]
CALL_SCHEMA = ("time string, store string, id string, stage string, model string, url string, "
               "request_bytes long, status int, latency_ms long, response_bytes long, outcome string, "
               "error string, finish_reason string, prompt_tokens long, completion_tokens long")
# -------------------------------------------------------------------------------------------------


def v(local: str) -> str:
    """The full IRI of a vocabulary name."""
    return VOCAB + local


def datatype_range(local: str) -> str | None:
    return next((r for rows in DATATYPE_PROPERTIES.values() for n, r in rows if n == local), None)


def settable() -> dict[str, str]:
    """Names a person may set, with their ranges: all media and image properties, and the description."""
    rows = DATATYPE_PROPERTIES["Media"] + DATATYPE_PROPERTIES["Image"]
    return {**dict(rows), "description": "string"}

# What a call's error text says when the service was out of reach, or its quota spent.
UNREACHABLE_SAYS = ("error sending request", "connection", "timed out")
QUOTA_SAYS = "402 quota exceeded"
