"""bracketry: point-in-time contest analytics as Spark plans."""
