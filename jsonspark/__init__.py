"""JSON restructuring and normalisation on Spark."""

from .api import JsonOutput, JsonSpark
from .config import BooleanConversion, Config, DateConversion, NullConversion, NumberConversion
from .errors import JsonSparkError

__version__ = "0.1.0"
__all__ = ["BooleanConversion", "Config", "DateConversion", "JsonOutput", "JsonSpark", "JsonSparkError", "NullConversion", "NumberConversion"]
