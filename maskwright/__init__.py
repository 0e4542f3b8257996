"""Finding, replacing and auditing personal data in document text, as DataFrame plans."""

from .config import Config
from .plans.pipeline import Masker

__version__ = "0.2.0"
__all__ = ["Config", "Masker", "__version__"]
