"""Column functions: Column in, Column out; all JVM-side but for those in decode.py."""
