"""Unicode property tables."""

import pytest

from gristmill.operators import matching as m
from gristmill.plans.errors import PatternSyntaxError
from gristmill.plans.pattern import compile

POSITIVE = "Dia 0301,Ext 30fc,GrBase 0061,Ideo 4e00,IDST 2ff2,JoinC 200c,PatSyn 005b,QMark 201c,SD 0069,STerm 3002,Term 002c,UIdeo 6f22,XIDS 0041,XIDC 0301,ID_Compat_Math_Continue 00b2,ID_Compat_Math_Start 2202,Modifier_Combining_Mark 0654,MCM 0654,Other_Alphabetic 0345,OAlpha 0345,Other_Default_Ignorable_Code_Point 034f,ODI 034f,Other_ID_Continue 00b7,OIDC 00b7,Other_ID_Start 1885,OIDS 1885,Other_Lowercase 00aa,OLower 00aa,Other_Math 005e,OMath 005e,Other_Uppercase 2160,OUpper 2160,Grapheme_Base 0061,XID_Start 0041,Any 1f600,ASCII 007f,Assigned 0041,InGreek_And_Coptic 03b1,Script_Extensions=Hira 30fc,sc=Greek 03b1,gc:Lu 0041,General_Category=Letter 0061,WB=ALetter 0061,GCB=Extend 0301,SB=Lower 0061,Unassigned 0378,LC 0041"
NEGATIVE = "Dash 0041,PatSyn 0061,Term 0061,RI 1f600,EMod 1f600,XIDC 002d,ASCII 0080,Assigned 0378,Block=Greek_And_Coptic 0041,ASCII_Hex_Digit 0067,sc=Hiragana 30fc,gc!=Lu 0041,^L 0061"
PAIRS = "L 0041 0031,M 0301 0041,N 0031 0041,P 0021 0041,S 002B 0041,Z 0020 0041,C 0000 0041,Lowercase_Letter 0061 0041,Titlecase_Letter 01C5 0061,Modifier_Letter 02B0 0061,Other_Letter 05D0 0061,Nonspacing_Mark 0301 0061,Spacing_Mark 0903 0061,Enclosing_Mark 20DD 0061,Decimal_Digit_Number 0031 0061,Letter_Number 2160 0061,Other_Number 00BD 0061,Connector_Punctuation 005F 0061,Dash_Punctuation 002D 0061,Open_Punctuation 0028 0061,Close_Punctuation 0029 0061,Initial_Punctuation 00AB 0061,Final_Punctuation 00BB 0061,Other_Punctuation 0021 0061,Control 0000 0041,Format 200C 0041,Private_Use E000 0041,Letter 0041 0031,Mark 0301 0041,Number 0031 0041,Punct 0021 0041,Symbol 002B 0041,Separator 0020 0041,Other 0000 0041"
CASES = [(*x.split(), True) for x in POSITIVE.split(",")] + [(*x.split(), False) for x in NEGATIVE.split(",")]
CASES += [(n, c, w) for n, a, b in (x.split() for x in PAIRS.split(",")) for c, w in ((a, True), (b, False))]


@pytest.mark.parametrize("name,code,want", CASES)
def test_property(name, code, want):
    text = chr(int(code, 16))
    assert m.is_match(compile(rf"\p{{{name}}}"), text) is want
    assert m.is_match(compile(rf"\P{{{name}}}"), text) is not want


@pytest.mark.parametrize("name", ["Age=V15_99", "Age=next", "Block=Not_A_Block", "sc=", "=Greek"])
def test_unknown(name):
    with pytest.raises(PatternSyntaxError):
        compile(rf"\p{{{name}}}")
