"""Error-tolerant readers of Rust, JavaScript / TypeScript, Python and Go: symbols and imports of top-level items."""
