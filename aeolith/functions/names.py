"""What names of variables say: kinds, measurements, the columns that belong to a flux, conventions of stamps, identifiers."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

#: Beginnings of names, their kind and category; the first that fits counts.
KINDS = (
    ("NEE", "NEE", "carbon"), ("GPP", "GPP", "carbon"), ("Reco", "Reco", "carbon"), ("FCH4", "FCH4", "carbon"), ("FN2O", "FN2O", "nitrogen"), ("FH2O", "FH2O", "water"), ("LE_", "LE", "water"), ("ET_", "ET", "water"),
    ("Rg_", "Rg", "radiation"), ("SW_IN_", "SW_IN", "radiation"), ("PPFD", "PPFD", "radiation"), ("PAR_", "PAR", "radiation"), ("LW_", "LW", "radiation"), ("Tair", "TA", "meteo"), ("TA_", "TA", "meteo"), ("VPD", "VPD", "meteo"), ("SWC", "SWC", "soil"),
)
#: Whole names, which may also be followed by an underscore, or stand alone.
EXACT = {"FC": ("FC", "carbon"), "TA": ("TA", "meteo")}
#: Measurements by code.
MEASUREMENTS = {
    "TA": "air temperature", "RH": "relative humidity", "VPD": "vapor pressure deficit", "SW": "shortwave radiation", "LW": "longwave radiation", "PPFD": "photosynthetic photon flux density", "PA": "air pressure",
    "PREC": "precipitation", "WS": "wind speed", "WD": "wind direction", "SWC": "soil water content", "TS": "soil temperature", "G": "soil heat flux",
}
#: Beginnings of names and the measurement's code; the first that fits counts.
MEASURED = (
    ("SWC", "SWC"), ("SW_", "SW"), ("SW", "SW"), ("PPFD", "PPFD"), ("LW", "LW"), ("RH", "RH"), ("VPD", "VPD"), ("TA", "TA"), ("Tair", "TA"), ("TS", "TS"), ("PREC", "PREC"), ("PA", "PA"), ("WS", "WS"), ("WD", "WD"), ("G_", "G"),
)
#: Base variable of each flux, and the column of its storage term.
BASES = {"FC": "CO2", "FH2O": "H2O", "LE": "H2O", "ET": "H2O", "H": "T_SONIC", "FN2O": "N2O", "FCH4": "CH4"}
STORAGE = {"FC": "SC_SINGLE", "FH2O": "SH2O_SINGLE", "LE": "SLE_SINGLE", "ET": "SET_SINGLE", "FN2O": "SN2O_SINGLE", "FCH4": "SCH4_SINGLE", "H": "SH_SINGLE"}
#: What marks the flags of a flux, by the flux's name.
FLAG_MARKS = {"NEE": ("_FC_", "_NEE_", "_co2_flux_"), "FC": ("_FC_", "_NEE_", "_co2_flux_"), "co2_flux": ("_FC_", "_NEE_", "_co2_flux_")} | {x: (f"_{x}_",) for x in ("H", "LE", "ET", "FH2O", "h2o_flux", "TAU", "FN2O", "FCH4")}
STAMPS = {"TIMESTAMP_END": "end", "TIMESTAMP_MIDDLE": "middle", "TIMESTAMP_START": "start"}


@dataclass(frozen=True)
class Kind:
    kind: str
    category: str


@dataclass(frozen=True)
class Measurement:
    code: str
    description: str


@dataclass(frozen=True)
class Correction:
    """A correction on offer: its key, a label, and whether it needs the site's coordinates."""

    key: str
    label: str
    needs_site: bool = False
    only: tuple[str, ...] = ()


#: Corrections by key, in the order they are offered; only names the measurements a special one is for.
CORRECTIONS = (
    Correction("radiation_zero_offset", "Remove nighttime zero offset", True, ("SW", "PPFD")), Correction("relativehumidity_offset", "Remove relative humidity offset", False, ("RH",)), Correction("setto_max", "Set to max threshold"),
    Correction("setto_min", "Set to min threshold"), Correction("setto_value", "Set to value"), Correction("set_exact_to_missing", "Set exact values to missing"),
)


def classify(name: object) -> Kind | None:
    """Kind and category of a variable by the beginning of its name; None for others."""
    if not isinstance(name, str):
        return None
    if name in EXACT or name.startswith("FC_"):
        return Kind(*EXACT[name.split("_")[0]])
    return next((Kind(k, c) for head, k, c in KINDS if name.startswith(head)), None)


def pick(columns: list[str], needle: str, prefer: str | None = None, avoid: str | None = None) -> str:
    """The first column with needle in its upper-cased name, those with prefer first, those with avoid never; empty for none."""
    fit = [c for c in columns if needle in c.upper() and not (avoid and avoid in c.upper())]
    return next((c for c in fit if prefer and prefer in c.upper()), fit[0] if fit else "")


def measurement_of(name: str) -> str | None:
    return next((code for head, code in MEASURED if name.startswith(head)), None)


def measurement_label(code: str) -> str:
    return f"{code} - {MEASUREMENTS[code]}" if code in MEASUREMENTS else code


def correction(key: str) -> Correction | None:
    return next((c for c in CORRECTIONS if c.key == key), None)


def corrections_for(code: str | None) -> list[str]:
    """Keys of the corrections that a measurement may take; those made for others are left out."""
    return [c.key for c in CORRECTIONS if not c.only or code in c.only]


def flag_marks(flux: str) -> tuple[str, ...]:
    """What the names of a flux's flags contain; the name itself for fluxes that aren't known."""
    if flux.startswith("NEE_"):
        return FLAG_MARKS["NEE"]
    if flux.startswith("co2_flux_"):
        return ("CHECK", "_NEE_")
    known = [x for x in FLAG_MARKS if x not in ("NEE", "FC", "co2_flux") and flux.startswith(f"{x}_")]
    return FLAG_MARKS.get(known[0] if known else flux, (flux,)) if flux != "NEE" else (flux,)


def flag_columns(columns: list[str], flux: str, without: list[str] | None = None) -> list[str]:
    """Columns ``FLAG_*_TEST`` and ``FLAG_*_QCF`` of a flux, but for those of the named scenarios."""
    flags = [c for c in columns if c.startswith("FLAG_") and c.endswith(("_TEST", "_QCF")) and any(m in c for m in flag_marks(flux))]
    return [c for c in flags if not any(x in c for x in without or [])]


def base_variable(flux: str) -> str:
    """The variable a flux is worked out from; KeyError for one that isn't known."""
    return BASES[flux]


def storage_column(flux: str) -> str | None:
    return STORAGE.get(flux)


def raw_test_inputs(flux: str, base: str) -> dict[str, list[str]]:
    """Columns that each raw test reads; the column of signal strength is the user's to name."""
    return {
        "ssitc": [f"{flux}_SSITC_TEST"], "gas_completeness": ["EXPECT_NR", f"{base}_NR"], "spectral_correction_factor": [f"{flux}_SCF"], "signal_strength": [], "raw_data_screening_vm97": [f"{base}_VM97_TEST"],
        "angle_of_attack": ["VM97_AOA_HF"], "steadiness_of_horizontal_wind": ["VM97_NSHW_HF"],
    }


def stamp_convention(name: str) -> str:
    """end, middle or start; ValueError for names that follow no convention."""
    if name not in STAMPS:
        raise ValueError(f"{name} is none of {', '.join(STAMPS)}")
    return STAMPS[name]


def check_stamp_name(name: str, convention: str) -> str:
    """name, if it isn't reserved for another convention."""
    if STAMPS.get(name, convention) != convention:
        raise ValueError(f"{name} stands for the {STAMPS[name]} of an interval, not its {convention}")
    return name


def with_tokens(names: list[str], tokens: list[str]) -> list[str]:
    return [n for n in names if all(t in n for t in tokens)]


def repeated(names: list[str]) -> dict[str, int]:
    return {n: k for n, k in Counter(names).items() if k > 1}


def id_suffix(text: str | None) -> str:
    """The identifier with one underscore before it, or nothing."""
    return f"_{text.lstrip('_')}" if text else ""


def event_flag(name: str) -> str:
    return "EVENT_" + "_".join(name.split())


def first_words(text: str, n: int = 50) -> str:
    return " ".join(text.split()[:n])
