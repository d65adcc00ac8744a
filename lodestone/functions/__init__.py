"""Column functions: text, scores and rendering, all inside the JVM."""
