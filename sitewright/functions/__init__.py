"""Column functions."""

from sitewright.functions.editing import EditingType
from sitewright.functions.tags import base_code, clean_tag, decode_base, site_id

__all__ = ["EditingType", "base_code", "clean_tag", "decode_base", "site_id"]
