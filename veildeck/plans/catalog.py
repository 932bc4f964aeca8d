"""The default catalog of identifier categories, the default profile, and the tag dictionary they use.

Any other catalog or profile of the same shape can be read from YAML."""

from __future__ import annotations

import copy
from pathlib import Path
from typing import Any

# Categories in order, with their action and the tags they cover.
CATEGORIES: list[tuple[str, str, str, list[str]]] = [
    ("names", "critical", "D", ["(0010,0010) PatientName", "(0008,0090) ReferringPhysicianName", "(0008,1050) PerformingPhysicianName", "(0008,1070) OperatorsName", "(0008,1048) PhysiciansOfRecord", "(0008,1060) NameOfPhysiciansReadingStudy", "(0010,2297) ResponsiblePerson"]),
    ("national_id", "critical", "H", ["(0010,0020) PatientID", "(0010,1000) OtherPatientIDs", "(0010,1002) OtherPatientIDsSequence"]),
    ("telephone", "high", "X", ["(0010,2154) PatientTelephoneNumbers"]),
    ("email", "high", "X", []),
    ("biometrics", "critical", "X", ["(5400,0100) WaveformSequence", "(0018,1150) ExposureTime"]),
    ("case_number", "critical", "H", ["(0008,0050) AccessionNumber"]),
    ("visit_encounter", "high", "H", ["(0038,0010) AdmissionID", "(0038,0011) IssuerOfAdmissionID", "(0038,0300) CurrentPatientLocation"]),
    ("mrn", "critical", "H", ["(0010,0020) PatientID"]),
    ("financial", "high", "X", []),
    ("device_serial", "medium", "X", ["(0018,1000) DeviceSerialNumber", "(0018,1002) DeviceUID", "(0018,100B) ManufacturerDeviceClassUID", "(0020,4000) ImageComments"]),
    ("cert_license", "medium", "X", []),
    ("postal_code", "high", "X", ["(0010,1040) PatientAddress", "(0010,2152) RegionOfResidence"]),
    ("street_address", "high", "X", ["(0010,1040) PatientAddress"]),
    ("death_dates", "high", "X", []),
    ("encapsulated_documents", "critical", "X", ["(0042,0011) EncapsulatedDocument"]),
    ("linked_dates", "high", "profile_dates", ["(0008,0020) StudyDate", "(0008,0021) SeriesDate", "(0008,0022) AcquisitionDate", "(0008,0023) ContentDate", "(0008,0030) StudyTime", "(0010,0030) PatientBirthDate", "(0038,0020) AdmittingDate", "(0038,0021) AdmittingTime"]),
]
UID_TAGS = ["(0008,0018) SOPInstanceUID", "(0020,000D) StudyInstanceUID", "(0020,000E) SeriesInstanceUID", "(0020,0052) FrameOfReferenceUID", "(0008,1155) ReferencedSOPInstanceUID"]
FREE_TEXT_TAGS = ["(0008,1030) StudyDescription", "(0008,103E) SeriesDescription", "(0010,4000) PatientComments", "(0020,4000) ImageComments", "(0018,1030) ProtocolName", "(0008,1080) AdmittingDiagnosesDescription"]
DATE_ACTIONS = {"remove": "X", "shift": "S", "keep": "K"}
TEXT_VRS = ("LO", "SH", "ST", "LT", "UT", "PN", "UC")
BULK_VRS = ("OB", "OW", "OF", "OD", "UN")
DATE_VRS = ("DA", "DT", "TM")
KNOWN_VALUE_TAGS = ["(0010,0010) PatientName", "(0010,0020) PatientID", "(0010,1000) OtherPatientIDs", "(0010,1001) OtherPatientNames", "(0008,0050) AccessionNumber", "(0008,0090) ReferringPhysicianName", "(0008,1050) PerformingPhysicianName", "(0008,1070) OperatorsName"]
JSON_KNOWN_KEYS = ("PatientName", "PatientID", "OtherPatientIDs", "OtherPatientNames", "AccessionNumber", "ReferringPhysicianName", "PerformingPhysicianName", "OperatorsName")
PROVENANCE_TAGS = (0x00120062, 0x00120063, 0x00120064)
ENCAPSULATED_DOCUMENT, WAVEFORM_SEQUENCE, PIXEL_DATA = 0x00420011, 0x54000100, 0x7FE00010
#: VRs of the dictionary's tags; the others are LO.
VRS = {
    "PN": [0x00100010, 0x00080090, 0x00081050, 0x00081070, 0x00081048, 0x00081060, 0x00102297, 0x00101001],
    "SH": [0x00080050, 0x00102154, 0x00101010],
    "SQ": [0x00101002, 0x54000100],
    "DA": [0x00080020, 0x00080021, 0x00080022, 0x00080023, 0x00100030, 0x00380020],
    "TM": [0x00080030, 0x00380021, 0x00080031, 0x00080032],
    "DT": [0x0008002A],
    "UI": [0x00080018, 0x0020000D, 0x0020000E, 0x00200052, 0x00081155, 0x00181002, 0x0018100B],
    "LT": [0x00104000, 0x00204000],
    "OB": [0x00420011],
    "OW": [0x7FE00010],
    "IS": [0x00181150],
    "CS": [0x00080060, 0x00120062],
}
OTHER_KEYWORDS = ["(0010,1001) OtherPatientNames", "(0008,0080) InstitutionName", "(0008,002A) AcquisitionDateTime", "(0008,0031) SeriesTime", "(0008,0032) AcquisitionTime", "(0008,0060) Modality", "(0012,0062) PatientIdentityRemoved", "(0012,0063) DeidentificationMethod", "(7FE0,0010) PixelData", "(0010,0040) PatientSex"]

DEFAULT_PROFILE: dict[str, Any] = {
    "id": "default",
    "label": "Default",
    "dates": {"mode": "remove", "offset_days_range": [-365, 365]},
    "pseudonym": {"hash_truncate": 16},
    "private_tags": {"policy": "strip_unknown", "allowlist": []},
    "text_detection": {"detect_dates": True, "dates_include_bare": False, "gazetteer_files": [], "extra_gazetteer_files": [], "custom_regex": []},
    "encapsulated_pdf": {"mode": "remove", "dpi": 150},
    "options": {"clean_pixel_data": False},
    "pixel": {"auto_detect": True, "require_human_confirm": True},
    "deface": {"enabled": False},
}


def tag_of(text: str) -> int | None:
    """(gggg,eeee) anywhere in a text, as one number."""
    import re

    m = re.search(r"\(\s*([0-9A-Fa-f]{4})\s*,\s*([0-9A-Fa-f]{4})\s*\)", str(text or ""))
    return int(m[1] + m[2], 16) if m else None


def default_catalog() -> dict:
    return {
        "categories": [{"id": i, "label": i.replace("_", " "), "priority": p, "action": a, "dicom_tags": list(t)} for i, p, a, t in CATEGORIES],
        "uid_remap": {"action": "U", "tags": list(UID_TAGS)},
    }


def dictionary() -> list[tuple[int, str, str]]:
    """tag, keyword, vr of all tags named above."""
    vr = {t: v for v, tags in VRS.items() for t in tags}
    named: dict[int, str] = {}
    for text in [*(t for *_, tags in CATEGORIES for t in tags), *UID_TAGS, *FREE_TEXT_TAGS, *KNOWN_VALUE_TAGS, *OTHER_KEYWORDS]:
        named.setdefault(tag_of(text), text.split(") ")[1])
    return [(t, k, vr.get(t, "LO")) for t, k in sorted(named.items())]


def load_yaml(path: str) -> dict:
    import yaml

    return yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}


class Profiles:
    """Profiles by id; a workspace folder's shadow the built-in one and are the only ones written."""

    def __init__(self, workspace: str | None = None):
        self.folder = Path(workspace) / "profiles" if workspace else None

    def _path(self, profile_id: str) -> Path | None:
        return self.folder / f"{profile_id}.yml" if self.folder else None

    def get(self, profile_id: str = "default") -> dict:
        path = self._path(profile_id)
        if path and path.exists():
            return load_yaml(str(path)) | {"_source": "workspace"}
        if profile_id == "default":
            return copy.deepcopy(DEFAULT_PROFILE) | {"_source": "shipped"}
        raise KeyError(f"no profile {profile_id!r}")

    def save(self, profile_id: str, profile: dict) -> str:
        import yaml

        if not self.folder:
            raise ValueError("profiles are written to a workspace only")
        self.folder.mkdir(parents=True, exist_ok=True)
        kept = {k: v for k, v in profile.items() if k != "_source"} | {"id": profile_id}
        path = self._path(profile_id)
        path.write_text(yaml.safe_dump(kept, sort_keys=False, allow_unicode=True), encoding="utf-8")
        return str(path)

    def clone(self, source: str, new: str, label: str | None = None) -> str:
        return self.save(new, self.get(source) | {"based_on": source, "label": label or new})

    def ids(self) -> list[tuple[str, str]]:
        """Every profile with where it comes from; the workspace wins."""
        own = {p.stem: "workspace" for p in sorted(self.folder.glob("*.yml"))} if self.folder and self.folder.exists() else {}
        return sorted(({"default": "shipped"} | own).items())

    # --- custom rules of a workspace profile

    def rules(self, profile_id: str = "default") -> list[dict]:
        return list((self.get(profile_id).get("text_detection") or {}).get("custom_regex") or [])

    def add_rule(self, profile_id: str, category: str, pattern: str, score: float = 0.95) -> bool:
        profile = self.get(profile_id)
        held = profile.setdefault("text_detection", {}).setdefault("custom_regex", [])
        rule = {"category": category, "pattern": pattern, "score": float(score)}
        if rule in held:
            return False
        held.append(rule)
        self.save(profile_id, profile)
        return True

    def remove_rules(self, profile_id: str, category: str | None = None, pattern: str | None = None) -> int:
        """Rules that match all that is given; nothing given removes nothing."""
        path = self._path(profile_id)
        if (category is None and pattern is None) or not path or not path.exists():
            return 0
        profile = self.get(profile_id)
        held = (profile.get("text_detection") or {}).get("custom_regex") or []
        gone = [r for r in held if category in (None, r.get("category")) and pattern in (None, r.get("pattern"))]
        profile.setdefault("text_detection", {})["custom_regex"] = [r for r in held if r not in gone]
        self.save(profile_id, profile)
        return len(gone)


def with_overrides(profile: dict, autoredact: bool | None = None, pdf_mode: str | None = None, pdf_dpi: int | None = None, deface: bool | None = None) -> dict:
    """A copy with one run's choices; the profile itself stays as it is."""
    p = copy.deepcopy(profile)
    if autoredact is not None:
        p.setdefault("options", {})["clean_pixel_data"] = bool(autoredact)
        if autoredact:
            p.setdefault("pixel", {}).update(auto_detect=True, require_human_confirm=False)
    if pdf_mode:
        p.setdefault("encapsulated_pdf", {})["mode"] = pdf_mode
    if pdf_dpi:
        p.setdefault("encapsulated_pdf", {})["dpi"] = int(pdf_dpi)
    if deface is not None:
        p.setdefault("deface", {})["enabled"] = bool(deface)
    return p


def pixel_autoredact(profile: dict) -> bool:
    """Unattended pixel redaction: wanted, detected, and not waiting for a person."""
    pixel = profile.get("pixel") or {}
    return bool((profile.get("options") or {}).get("clean_pixel_data")) and bool(pixel.get("auto_detect")) and not pixel.get("require_human_confirm", True)
