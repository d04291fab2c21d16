"""quirel.streaming"""
