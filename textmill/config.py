"""Settings of the text refiner: presets, overrides, and the gates that they open."""

from __future__ import annotations

from dataclasses import dataclass, replace

PROFILES = ("safe", "strict", "markdown_safe")
CATEGORIES = tuple("boilerplate header_footer hyphen_fix layout_noise other paragraph_merge references_section section_marker_inserted toc toc_navigation".split())
TEXT_PROFILES = ("clean_web", "pdf_like", "ocr_like", "unknown")


@dataclass(frozen=True)
class RefineConfig:
    """profile: safe, strict or markdown_safe. normalize_extracted: True, False or "auto". Toggles: off, on or auto.
    structure_mode: off, light or aggressive."""

    collapse_blank_lines: bool = True
    drop_layout_noise: str = "auto"
    drop_references_section: str = "off"
    drop_repeated_lines: str = "off"
    normalize_extracted: bool | str = "auto"
    normalize_form: str = "NFKC"
    preserve_markdown_tables: bool | None = None
    profile: str = "safe"
    structure_mode: str = "off"

    @property
    def keeps_tables(self) -> bool:
        return self.profile != "strict" if self.preserve_markdown_tables is None else self.preserve_markdown_tables

    @property
    def bullet(self) -> str:
        return "-" if self.profile == "markdown_safe" else "\u2022"

    @property
    def drops_dotted_toc(self) -> bool:
        return self.profile in ("safe", "strict")


PRESETS = {
    "safe": RefineConfig(),
    "bench": RefineConfig(),
    "strict": RefineConfig(profile="strict", drop_references_section="on", structure_mode="light"),
    "light": RefineConfig(collapse_blank_lines=False, drop_repeated_lines="auto"),
}


#: The six texts of a document that an evaluation compares: preset and settings.
VARIANTS: dict[str, tuple[str, dict[str, str]]] = {
    "raw": ("raw", {}),
    "plain": ("safe", {}),
    "light": ("light", {}),
    "aggressive": ("safe", {"structure_mode": "aggressive"}),
    "drops": ("safe", {"drop_repeated_lines": "auto", "drop_references_section": "auto"}),
    "structure": ("safe", {"structure_mode": "light", "drop_layout_noise": "off"}),
}


def resolve(preset: str = "safe", **overrides: object) -> RefineConfig:
    """The preset's settings with every override that isn't None; "raw" (which bypasses refinement) resolves like safe.

    An unknown preset raises KeyError, an unknown setting TypeError.
    """
    return replace(PRESETS["safe" if preset == "raw" else preset], **{k: v for k, v in overrides.items() if v is not None})


def gate(toggle: str, extracted: bool) -> bool:
    """Whether a toggle acts; auto acts on text that was normalised as extracted from PDF or OCR."""
    return toggle == "on" or (toggle == "auto" and extracted)
