"""Column functions: text, numbers, and random choice by key."""
