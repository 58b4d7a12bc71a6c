"""Column expressions; everything here stays inside the JVM except ``topic`` and ``scorers``."""
